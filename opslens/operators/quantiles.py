"""Exact interpolated quantiles that never gather a group in one task."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import present

# Whisker, box and tail points of the distribution reports.
BOX_POINTS = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p80": 0.80, "p90": 0.90}

# Least number of coarse buckets, and of fine ones in each.
FAN = 16


def distribution(df: DataFrame, keys: list[str], value: str,
                 points: dict[str, float] | None = None, fan: int | None = None) -> DataFrame:
    """Rows, mean and linearly interpolated quantiles of ``value`` per ``keys``.

    ``n`` counts every row of the group, also those without a value; the mean
    and the quantiles skip missing values.

    ``F.percentile`` would build the whole value histogram of a group in one
    task, and the groups here (a week, a label) may hold most rows. Instead the
    histogram is pre-aggregated map-side and cut into buckets at approximate
    quantiles of the whole column. The buckets are counted first, in a table
    with at most ``fan * fan + 2`` rows per group; only those that hold a wanted
    rank are then sorted and ranked, at most two per point and group.
    ``fan * fan`` is at least the session's number of shuffle partitions, so
    the buckets keep up with the cluster; the result does not depend on it.
    """
    if fan is None:
        fan = max(FAN, math.ceil(math.sqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    n_buckets = fan * fan
    points = BOX_POINTS if points is None else points
    rows = present(df, *keys).select(*keys, F.col(value).cast("double").alias("_v"))
    counts = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    # Always true, but it keeps the histogram here the same as below, so that it is built once.
    cuts = counts.where(F.col("_c") > 0).agg(
        F.percentile_approx("_v", [i / n_buckets for i in range(1, n_buckets)], 4 * n_buckets).alias("_fine")
    ).select(F.struct(
        F.transform(F.sequence(F.lit(fan), F.lit(n_buckets - fan), F.lit(fan)),
                    lambda i: F.get("_fine", i - 1)).alias("coarse"),
        F.col("_fine").alias("fine")).alias("cuts"))

    def passed(edges):
        return F.size(F.filter(edges, lambda e: e <= F.col("_v")))

    hist = (
        counts.withColumn("_cuts", cuts.scalar())
        .withColumn("_coarse", fan * passed(F.col("_cuts.coarse")))
        .withColumn("_bucket", F.when(F.col("_v").isNull(), F.lit(-1)).otherwise(F.coalesce(
            F.col("_coarse") + passed(F.slice("_cuts.fine", F.col("_coarse") + 1, F.lit(fan - 1))), F.lit(-1))))
        .drop("_cuts", "_coarse")
        .withColumn("_w", F.when(F.col("_v").isNotNull(), F.col("_c")).otherwise(F.lit(0)))
    )
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        hist.groupBy(*keys, "_bucket")
        .agg(F.sum("_w").alias("_bw"), F.sum("_c").alias("_bc"), F.sum(F.col("_v") * F.col("_c")).alias("_bs"))
        .select(*keys, "_bucket",
                "_bw",
                F.coalesce(F.sum("_bw").over(before), F.lit(0)).alias("_offset"),
                F.sum("_bw").over(whole).alias("_n"),
                F.sum("_bc").over(whole).alias("_rows"),
                F.sum("_bs").over(whole).alias("_sum"))
    )
    # The bucket is never null: otherwise the join would have the optimizer test the
    # bucket expression on every row below the histogram.
    ranks = [end((F.col("_n") - 1) * F.lit(q)) for q in points.values() for end in (F.floor, F.ceil)]
    held = [(F.col("_offset") <= r) & (r < F.col("_offset") + F.col("_bw")) for r in ranks]
    # A group without values still shows its rows.
    wanted = buckets.where(reduce(or_, held, F.col("_n") == 0 if held else F.lit(True)))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        hist.join(wanted, [*keys, "_bucket"])
        .withColumn("_hi", F.col("_offset") + F.sum("_w").over(inside))
        .withColumn("_lo", F.col("_hi") - F.col("_w"))
    )

    def value_at(rank):
        return F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")), F.col("_v")))

    picks = []
    for name, q in points.items():
        position = (F.col("_n") - 1) * F.lit(q)
        picks += [value_at(F.floor(position)).alias(f"_{name}_a"), value_at(F.ceil(position)).alias(f"_{name}_b")]
    found = ranked.groupBy(*keys).agg(
        F.max("_rows").alias("n"), F.max("_n").alias("_n"), F.max("_sum").alias("_sum"), *picks)

    def interpolated(name, q):
        position = (F.col("_n") - 1) * F.lit(q)
        low, high = F.col(f"_{name}_a"), F.col(f"_{name}_b")
        return (low + (high - low) * (position - F.floor(position))).alias(name)

    return found.select(*keys, "n", F.try_divide("_sum", "_n").alias("mean"),
                        *[interpolated(name, q) for name, q in points.items()])
