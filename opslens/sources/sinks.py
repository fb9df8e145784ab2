"""Report outputs: whole tables, one folder per group, several named tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_by_group(df: DataFrame, path: str, keys: list[str], fmt: str = "parquet",
                   mode: str = "overwrite") -> None:
    """One folder per value of ``keys``.

    The rows are rebalanced on the keys first: a small group is written by one
    task, a large one is split among several by its size.
    """
    writer = df.hint("rebalance", *keys).write.mode(mode).partitionBy(*keys)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def stack_reports(reports: dict[str, DataFrame], name: str = "variant") -> DataFrame:
    """Several reports as one table, each row naming its report; absent columns are null."""
    named = [df.select(F.lit(k).alias(name), "*") for k, df in reports.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)
