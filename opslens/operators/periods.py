"""Period labels from a table of periods of any size, overlaps included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import days
from . import skew


def _binned(periods: DataFrame, end_days: int) -> DataFrame:
    """One row per calendar day: the periods that can be the first match of a time on it, in order.

    Of the periods that cover the whole day only the first is kept, and of those that begin and end at the
    same times within it too, both by map-side aggregates. So a day's list is as long as
    the number of different cuts inside the day, however many periods overlap it.
    """
    stamp = "timestamp_ntz"
    known = periods.select(
        "ord", "label", F.col("start").cast(stamp).alias("_a"),
        (F.col("end").cast(stamp) + days(end_days)).alias("_z")).where(F.col("_a") <= F.col("_z"))
    each = known.withColumn("_day", F.explode(F.sequence(F.to_date("_a"), F.to_date("_z"))))
    opens, closes = F.col("_day").cast(stamp), F.col("_day").cast(stamp) + days(1)
    inside = each.select(
        "_day",
        F.when(F.col("_a") > opens, F.col("_a")).alias("_a"),
        F.when(F.col("_z") < closes, F.col("_z")).alias("_z"),
        F.struct("ord", "label").alias("_p"))
    firsts = inside.groupBy("_day", "_a", "_z").agg(F.min("_p").alias("_p"))
    lists = firsts.groupBy("_day").agg(
        F.min(F.when(F.col("_a").isNull() & F.col("_z").isNull(), F.col("_p"))).alias("_whole"),
        F.sort_array(F.collect_list(F.struct("_p", "_a", "_z"))).alias("_list"))
    # What comes after the first period that covers the day can never be the first match.
    return lists.select("_day", F.filter(
        "_list", lambda x: F.col("_whole").isNull() | (x["_p"] <= F.col("_whole"))).alias("_list"))


def with_period(df: DataFrame, col: str, periods: DataFrame, name: str, default: str | None = None,
                end_days: int = 1, spread: Column | None = None) -> DataFrame:
    """Adds ``name``: the label of the first period (by ``ord``, then label) that contains ``col``.

    ``periods`` has ``ord``, ``label``, ``start`` and ``end`` (dates or times); a period contains
    ``start <= col <= end + end_days``. A period with a missing bound, or one that ends before it starts, contains nothing.
    Times outside every period, and missing ones, take ``default``. Rows keep their number: repeated periods add none.

    Rows and periods meet by calendar day, so the join is an equality and neither side is held whole.
    ``spread`` is a column that differs between the rows of one day (default: ``col``).
    """
    value = F.col(col).cast("timestamp_ntz")
    keyed = df.withColumn("_day", F.to_date(value))
    found = skew.lookup(keyed, _binned(periods, end_days), "_day", value if spread is None else spread)
    fits = F.filter("_list", lambda x: (x["_a"].isNull() | (x["_a"] <= value)) & (x["_z"].isNull() | (value <= x["_z"])))
    return found.withColumn(name, F.coalesce(F.get(fits, F.lit(0))["_p"]["label"], F.lit(default))).drop("_day", "_list")
