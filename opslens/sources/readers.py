"""Scans of exported tables: CSV text or Parquet, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import read_time
from .schemas import TABLES

_LENIENT = (T.DoubleType, T.LongType, T.IntegerType, T.BooleanType)


def read_table(spark: SparkSession, table: str, path, columns: list[str] | None = None,
               fmt: str = "parquet", headers: dict[str, str] | None = None,
               time_pattern: str | None = None, optional: tuple[str, ...] = (),
               extra: tuple[str, ...] = (), multi_line: bool = False) -> DataFrame:
    """Read one of ``schemas.TABLES``, pruned to ``columns``.

    CSV files are read as text under their own ``headers`` (table column to
    file header; same name if missing). Text is converted leniently, in any
    format: an unreadable number or date becomes null. ``time_pattern`` is the
    pattern of the dates, for instance ``dd-MM-yyyy HH:mm`` for day-first
    exports. A column whose header is not found is an error, unless it is named
    in ``optional``; then it is left out. Columns named in ``extra`` are carried
    through as they are. ``multi_line`` reads quoted line breaks; such files
    cannot be split among tasks, so it is off unless asked for.
    """
    schema = TABLES[table]
    wanted = [f for f in schema.fields if columns is None or f.name in columns]
    headers = headers or {}
    if fmt == "csv":
        raw = (spark.read.option("header", True).option("enforceSchema", False).option("escape", '"')
               .option("multiLine", multi_line).csv(path))
    else:
        raw = spark.read.format(fmt).load(path)
    missing = [h for h in (headers.get(f.name, f.name) for f in wanted if f.name not in optional) if h not in raw.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    kinds = {f.name: f.dataType for f in raw.schema.fields}

    def column(f: T.StructField):
        header = headers.get(f.name, f.name)
        text = isinstance(kinds[header], T.StringType)
        value = F.col(f"`{header}`")
        return (_converted(value, f, time_pattern) if text else value.try_cast(f.dataType)).alias(f.name)

    return raw.select(*[column(f) for f in wanted if headers.get(f.name, f.name) in raw.columns],
                      *[F.col(f"`{c}`") for c in extra])


def _converted(text, field: T.StructField, time_pattern: str | None):
    if isinstance(field.dataType, T.TimestampNTZType):
        return read_time(text, time_pattern)
    if isinstance(field.dataType, (T.LongType, T.IntegerType)):
        # An integer column with gaps is often exported as '12.0'.
        return F.coalesce(F.trim(text).try_cast(field.dataType),
                          F.trim(text).try_cast("decimal(38,6)").try_cast(field.dataType))
    if isinstance(field.dataType, _LENIENT):
        return F.trim(text).try_cast(field.dataType)
    return text
