"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import pathlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths made since the innermost `scratch` began; None outside of any.
_MADE: list[str] | None = None


@contextlib.contextmanager
def scratch() -> Iterator[list[str]]:
    """Gathers the paths of the intermediate tables made inside, for `remove` once nothing reads them any more."""
    global _MADE
    outer, _MADE = _MADE, []
    try:
        yield _MADE
    finally:
        if outer is not None:
            outer.extend(_MADE)
        _MADE = outer


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes intermediate tables that `shared_dir` named."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one intermediate table, below the session's shared checkpoint folder.

    Only on a single machine (tests) a local one is made where none is configured; a
    cluster's executors could not read it, so there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="opslens-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _MADE is not None:
        _MADE.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what `materialise` wrote for frames that nothing reads any more."""
    for df in frames:
        remove(df.sparkSession, [df.stored_at])


def ship_package(spark: SparkSession) -> None:
    """Hands this package to the executors, once per session, as a Spark job's own Python files."""
    context = spark.sparkContext
    if getattr(context, "_opslens_shipped", False):
        return
    package = pathlib.Path(__file__).resolve().parent.parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='opslens-')}/opslens", "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._opslens_shipped = True


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder, for tasks that write or read flat files."""
    if "://" not in uri and ":" not in uri:
        uri = "file://" + uri
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and
                                  not uri.startswith("file://") else uri)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]
