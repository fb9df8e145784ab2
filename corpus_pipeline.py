"""A corpus from raw documents to token counts: each stage is written and read again as the next one's documents."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm import ngram_join, prefix_bpe, quality, tiling, toxicity
from opslens.llm.common import materialise, remove, scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: What the stage before left: it is read until that stage's rows are written.
_left: list[str] = []

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(work: Stage) -> Stage:
    """The stage, with the intermediate tables of the one before it deleted when it begins.

    By then that stage's rows are written. A frame that still reads such a table keeps them all.
    """
    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _tidy(spark, docs)
        with scratch() as made:
            kept = work(spark, docs, sf_dir)
        _left.extend(made)
        return kept

    return stage


def _tidy(spark: SparkSession, docs: DataFrame) -> None:
    files = docs.inputFiles()
    if not any(path.split(":", 1)[-1].lstrip("/") in f for path in _left for f in files):
        remove(spark, _left)
        _left.clear()


def _rows(docs: DataFrame) -> DataFrame:
    """The documents with a number for each row, written so that every reader sees the same numbers."""
    return materialise(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")


def _keep(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose number is in ``kept``: null and repeated doc_ids are decided row by row.

    A merge join at any size: a broadcast of the numbers would serve small tables only.
    """
    kept = materialise(kept.select("row"), "pipeline-kept")
    return rows.join(kept.hint("merge"), "row", "left_semi").select(*COLUMNS)


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the base rule or a certified cutoff go; other rows of the same doc_id, or of none, are not touched."""
    # the rows go with their counts, so no text is shuffled
    rows = docs.select(*COLUMNS, F.col("text").alias("whole"))
    ruled = quality.quality_rules(rows, table(spark, sf_dir, "labels"), carry=("whole", *COLUMNS[2:]))
    return ruled.where("kept").withColumnRenamed("whole", "text").select(*COLUMNS)


@_stage
def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go; other rows of the same doc_id, or of none, are not touched."""
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), carry=tuple(COLUMNS[1:]))
    return scored.where("predicted = 0").select(*COLUMNS)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near or exact copies (five words, similarity 0.8) the row with the smallest doc_id stays.

    Rows are grouped by text, also repeated rows and rows without doc_id; a null doc_id comes after
    all others, and one of several equal ones stays. Rows without words belong to no group and all stay.
    """
    rows = _rows(docs)
    groups = ngram_join.jaccard_components(rows.select(F.col("row").alias("doc_id"), "text"), size=5, percent=80, links=False)
    groups = groups.select(F.col("doc_id").alias("row"), "component_id").join(rows.select("row", "doc_id"), "row")
    return _keep(rows, groups.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row")))


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that cover a test item go; other rows of the same doc_id, or of none, are not touched."""
    rows = _rows(docs)
    found = tiling.contaminated(rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    found = materialise(found.select(F.col("doc_id").alias("row")).distinct(), "pipeline-leaks")
    return rows.join(found, "row", "left_anti").select(*COLUMNS)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return prefix_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]

#: The classifier and the tokenizer have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    _tidy(spark, docs)
    return docs
