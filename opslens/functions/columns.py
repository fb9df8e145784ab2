"""Null-aware predicates and arithmetic shared by the operators.

The reports treat a missing value as "different from everything": it passes a
``<>`` or NOT IN test, fails every comparison and never forms a group.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def differs(col: Column, value) -> Column:
    """``col <> value`` where a null differs from any value."""
    return ~col.eqNullSafe(value)


def not_in(col: Column, values: Iterable) -> Column:
    """NOT IN that keeps nulls."""
    return ~F.coalesce(col.isin(list(values)), F.lit(False))


def has_text(col: Column, text: str) -> Column:
    """Substring test, false for null."""
    return F.coalesce(col.contains(text), F.lit(False))


def holds(condition: Column) -> Column:
    """A condition with null read as false."""
    return F.coalesce(condition, F.lit(False))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null for a zero denominator."""
    return F.try_divide(numerator, denominator)


def to_number(col: Column) -> Column:
    """Lenient text to number: anything unreadable becomes null."""
    return F.trim(col.cast("string")).try_cast("double")


def or_zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0))


def null_if_zero(col: Column) -> Column:
    """Zero counts as absent: a label no row carries has no value."""
    return F.when(col != 0, col)


def positive_or_zero(col: Column) -> Column:
    """Negative and missing amounts become 0."""
    return F.when(col > 0, col).otherwise(F.lit(0.0))


def nps_score(feedback: Column) -> Column:
    """1-2 detract (-1), 3 is neutral (0), 4-5 promote (1); null stays null."""
    return F.when(feedback < 3, -1).when(feedback == 3, 0).when(feedback > 3, 1)


def nps_split(nps: Column) -> Column:
    """'-ve' for detractors, '+ve' for everything else, nulls included."""
    return F.when(nps == -1, "-ve").otherwise("+ve")


def present(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose grouping keys are all set: a null key forms no group."""
    if not keys:
        return df
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def first_present(col: str, order: str) -> Column:
    """Aggregate: the first non-null value of ``col`` by ``order``."""
    return F.min_by(F.col(col), F.when(F.col(col).isNotNull(), F.col(order)))


def label_bit(col: Column, labels: list[str], first: int) -> Column:
    """Bit ``first + i`` for the i-th label, 0 for any other value.

    Sets of small flags are folded with one ``bit_or`` rather than one
    aggregate per flag, which keeps wide reports in compact generated code.
    """
    out = F.lit(0)
    for i, name in reversed(list(enumerate(labels))):
        out = F.when(col == name, F.lit(1 << (first + i))).otherwise(out)
    return out


def bit_if(condition: Column, bits: Column) -> Column:
    return F.when(condition, bits).otherwise(F.lit(0))


def has_bit(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << bit)) != 0


def to_wide(df: DataFrame, rows: list[str], column: str, values: list[str], value: str) -> DataFrame:
    """One column per listed value; a combination that has no row stays null."""
    return df.groupBy(*rows).pivot(column, values).agg(F.first(value, ignorenulls=True))


def long_metrics(df: DataFrame, keys: list[str], metrics: list[tuple[int, str, Column]]) -> DataFrame:
    """Turn one wide row per key into ``(ord, metric, value)`` rows."""
    entries = F.array(*[
        F.struct(F.lit(o).alias("ord"), F.lit(name).alias("metric"), value.cast("double").alias("value"))
        for o, name, value in metrics
    ])
    return df.select(*keys, F.inline(entries))


def complete_labels(counts: DataFrame, column: str, labels: list[str], value: str) -> DataFrame:
    """Exactly one row per listed label, null where ``counts`` has none."""
    spark = counts.sparkSession
    listed = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], f"ord int, {column} string")
    return listed.join(counts.select(column, value), column, "left").select("ord", column, value)


def with_reason_rank(lines: DataFrame, keys: list[str], sections: list[int]) -> DataFrame:
    """Adds ``rank`` to report lines: a reason's place by falling value, ties by its label; null outside of ``sections``.

    Runs on report lines, a few per label and section.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("value"), "metric")
    return lines.withColumn("rank", F.when(F.col("ord").isin(sections), F.row_number().over(order)))
