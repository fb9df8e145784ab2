"""Token counts from flat, unindexed token files.

A token file is nothing but ids, 16 bits each, with an end-of-document id behind every
document. Counting cuts the files into blocks of fixed size, finds the separators of each
block at once, and leaves one summary per block. A prefix scan over the summaries, first
over groups of blocks and then inside each group, tells every block how many documents
end before it and how many tokens of its first document lie in earlier blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opslens.llm.common import map_arrow, materialise, open_store, shared_dir, texts_of

#: Blocks of one group of the prefix scan.
GROUP = 256


def write_token_files(docs: DataFrame, folder: str, encoder: Callable[[], Callable[[str], list[int]]],
                      separator: int) -> DataFrame:
    """Writes one token file per task below ``folder``; rows (file, bytes, ordinal, doc_id) say which documents it holds.

    The name of a file is new for every attempt of a task, and only the rows of the
    attempt that succeeds are kept, so what a lost executor leaves behind is never read.
    ``encoder`` is called once per task. Null texts are empty documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        name, encode, held, size = f"tokens-{uuid.uuid4().hex}.bin", encoder(), [], 0
        end = np.array([separator], np.uint16).tobytes()
        with store.open_output_stream(f"{path}/{name}", compression=None) as out:
            for batch in batches:
                for i in range(0, batch.num_rows, 1000):
                    part = batch.slice(i, 1000)
                    data = b"".join(np.array(encode(t), np.uint16).tobytes() + end for t in texts_of(part.column(1)))
                    out.write(data)
                    size += len(data)
                    held.append(part.column(0))
        if not held:
            store.delete_file(f"{path}/{name}")
            return
        ids = pa.concat_arrays(held)
        n = len(ids)
        yield pa.record_batch([pa.array([name] * n), pa.array(np.full(n, size)), pa.array(np.arange(n)), ids],
                              ["file", "bytes", "ordinal", "doc_id"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                     "file string, bytes long, ordinal long, doc_id long")


def scan_token_files(files: DataFrame, folder: str, separator: int, block_bytes: int = 4 << 20) -> DataFrame:
    """One row (file, ordinal, n_tokens) per document of the files (file, bytes); tokens behind the last separator are one more."""
    blocks = files.select("file", "bytes", F.explode(F.expr(
        f"sequence(0L, greatest(0L, cast((bytes - 1) div {block_bytes} as bigint)))")).alias("block"))
    blocks = blocks.where("bytes > 0").repartition("file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        for batch in batches:
            for file, size, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{path}/{file}") as source:
                    data = source.read_at(min(block_bytes, size - block * block_bytes), block * block_bytes)
                ids = np.frombuffer(data, np.uint16)
                at = np.flatnonzero(ids == separator)
                inner = np.diff(at) - 1
                yield pa.record_batch([
                    pa.array([file]), pa.array([block]), pa.array([len(at)], pa.int64()),
                    pa.array([int(at[0]) if len(at) else len(ids)], pa.int64()),
                    pa.array([len(ids) - 1 - int(at[-1]) if len(at) else len(ids)], pa.int64()),
                    pa.array([inner.astype(np.int64)], pa.list_(pa.int64()))],
                    ["file", "block", "ends", "head", "tail", "inner"])

    found = map_arrow(blocks, run, "file string, block long, ends long, head long, tail long, inner array<long>")
    found = materialise(found, "token-blocks")
    # a summary: documents that end, tokens behind the last end (all, if none ends)
    group = F.expr(f"block div {GROUP}")
    order = Window.partitionBy("file", "part").orderBy("block")
    rows = found.select("file", "block", "ends", "tail", group.alias("part"))
    inside = _scan(rows, order, "block")
    totals = _scan(rows.groupBy("file", "part").agg(F.sum("ends").alias("ends"), F.expr(
        "aggregate(array_sort(collect_list(struct(block, ends, tail))), 0L, (s, x) -> if(x.ends > 0, x.tail, s + x.tail))"
    ).alias("tail")), Window.partitionBy("file").orderBy("part"), "part")
    joined = inside.join(totals.select("file", "part", F.col("before").alias("g_before"), F.col("open").alias("g_open")),
                         ["file", "part"])
    carry = joined.select("file", "block", (F.col("before") + F.col("g_before")).alias("before"), F.when(
        F.col("before") > 0, F.col("open")).otherwise(F.col("open") + F.col("g_open")).alias("open"))
    stitched = found.join(carry, ["file", "block"])
    done = stitched.where("ends > 0").select("file", "before", F.posexplode(
        F.concat(F.array(F.col("head") + F.col("open")), "inner")).alias("i", "n_tokens"))
    done = done.select("file", (F.col("before") + F.col("i")).alias("ordinal"), "n_tokens")
    rest = stitched.groupBy("file").agg(F.max_by(F.struct(
        (F.col("before") + F.col("ends")).alias("ordinal"),
        F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("open") + F.col("tail")).alias("n_tokens")),
        "block").alias("x")).select("file", "x.ordinal", "x.n_tokens").where("n_tokens > 0")
    return done.unionByName(rest)


def _scan(rows: DataFrame, order, key: str) -> DataFrame:
    """Documents ended before each row, and the tokens open at its start."""
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"before": F.coalesce(F.sum("ends").over(before), F.lit(0)),
                             "since": F.coalesce(F.max(F.when(F.col("ends") > 0, F.col(key))).over(before), F.lit(-1)),
                             "run": F.coalesce(F.sum("tail").over(before), F.lit(0))})
    # open tokens: the tails from the last row with an end on
    until = F.max(F.when(F.col("ends") > 0, F.col("run"))).over(before)
    return rows.withColumn("open", F.col("run") - F.coalesce(until, F.lit(0)))


def count_tokens(docs: DataFrame, encoder: Callable[[], Callable[[str], list[int]]], separator: int,
                 block_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: doc_id and n_tokens, counted in token files that this writes first.

    Empty tables give no row; repeated and null doc_ids give a row each. ``encoder`` must
    never return the separator.
    """
    spark: SparkSession = docs.sparkSession
    folder = shared_dir(spark, "token-files")
    held = materialise(write_token_files(docs, folder, encoder, separator), "token-held")
    files = held.groupBy("file").agg(F.max("bytes").alias("bytes"))
    counted = scan_token_files(files, folder, separator, block_bytes)
    return held.join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens")
