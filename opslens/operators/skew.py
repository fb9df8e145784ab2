"""Helpers that keep one oversized key from landing in one task.

A key is oversized when it holds more than its share of the rows: a ``1 / (SHARE * P)``th
of them, P being the session's shuffle partitions. So there are never more than SHARE * P
such keys, whatever the size of the data, and small data meets the same plan as large data.

* ``attach`` and ``lookup`` join one-row-per-key columns back to the rows. Rows of the oversized
  keys take theirs from a broadcast and are spread over the shuffle, so they never meet in one partition.
* ``cut`` deals an ordered group of an oversized key into consecutive slices at sampled
  places of its order. An operator works slice by slice and carries what it needs from one
  slice into the next through a table with one row per slice of the oversized keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is oversized above a 1 / (SHARE * P)th of all rows; a slice holds about a 1 / (2 * P)th.
SHARE = 4
#: Sampled rows from one cut to the next.
_EVERY = 16
#: Slices of one key at most: what is composed over the slices of a key is as small.
MOST_SLICES = 4096

_SPREAD = 1 << 16


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def heaviest(stats: DataFrame, key: str, count: str = "n_rows", floor: int | None = None,
             most: int | None = None) -> DataFrame:
    """The oversized keys, at most SHARE * P; with ``floor``, those above so many rows instead.

    With ``most`` also every key above so many rows counts, for operators that hold a key's rows
    in one value: one more key per ``most`` rows at most.
    """
    if floor is not None:
        return stats.where(F.col(count) > floor)
    share = stats.agg(F.sum(count).alias("n")).scalar() / F.lit(float(SHARE * _partitions(stats)))
    return stats.where(F.col(count) > (share if most is None else F.least(share, F.lit(float(most)))))


def any_oversized(stats: DataFrame, count: str = "n_rows", floor: int | None = None, most: int | None = None) -> Column:
    """Whether ``heaviest`` has a key; as a filter it saves the passes that only oversized keys need."""
    share = F.sum(count) / F.lit(float(SHARE * _partitions(stats)))
    limit = F.lit(floor) if floor is not None else share if most is None else F.least(share, F.lit(float(most)))
    return stats.agg((F.max(count) > limit).alias("some")).scalar()


def built_once(stats: DataFrame, count: str = "n_rows") -> DataFrame:
    """Mark an aggregate that several later steps read.

    The condition always holds, but names every column: the optimizer then
    prunes no column from any of the uses, they stay the same plan, and Spark
    builds the aggregate once and reuses its exchange.
    """
    return stats.where((F.col(count) > 0) | (F.xxhash64(*stats.columns) == 0))


def key_counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))


def zero_of(key: str) -> Column:
    """0 for every key, as a column that depends on the key and is never null.

    A literal would be folded out of the join keys, and a nullable column would
    push a null test below the aggregate it is read from.
    """
    return F.xxhash64(key).bitwiseAND(F.lit(0).cast("bigint"))


def attach(rows: DataFrame, stats: DataFrame, key: str, spread: Column,
           floor: int | None = None) -> DataFrame:
    """Left join ``stats`` (one row per ``key``, with ``n_rows``) to ``rows``.

    ``spread`` is any column that differs between the rows of one key. The
    columns of ``stats`` other than the key and ``n_rows`` are added.
    """
    return _salted_join(rows, stats, heaviest(stats, key, floor=floor), key, spread)


def lookup(rows: DataFrame, table: DataFrame, key: str, spread: Column, floor: int | None = None) -> DataFrame:
    """Left join ``table`` (one row per ``key``) to ``rows`` whose counts per key are not known yet."""
    often = heaviest(key_counts(rows, key), key, floor=floor).select(F.col(key).alias("_often"))
    heavy = table.join(F.broadcast(often), F.col(key) == F.col("_often"), "inner").drop("_often")
    return _salted_join(rows, table, heavy, key, spread)


def _salted_join(rows: DataFrame, table: DataFrame, heavy: DataFrame, key: str, spread: Column) -> DataFrame:
    """Rows of the ``heavy`` keys take their columns from a broadcast and are spread over the shuffle."""
    added = [c for c in table.columns if c not in (key, "n_rows")]
    bundle = F.struct(*added)
    few = heavy.select(F.col(key).alias("_sj_few_key"), bundle.alias("_sj_few"))
    light = table.select(F.col(key).alias("_sj_key"), zero_of(key).alias("_sj_zero"), bundle.alias("_sj_light"))
    marked = rows.join(F.broadcast(few), F.col(key) == F.col("_sj_few_key"), "left")
    alone = F.col("_sj_few_key").isNotNull() | F.col(key).isNull()
    marked = marked.withColumn(
        "_sj_salt",
        F.when(alone, F.lit(1) + F.pmod(F.xxhash64(spread), F.lit(_SPREAD))).otherwise(F.lit(0)).cast("bigint"))
    joined = marked.join(light, (F.col(key) == F.col("_sj_key")) & (F.col("_sj_salt") == F.col("_sj_zero")), "left")
    found = F.coalesce(F.col("_sj_few"), F.col("_sj_light"))
    return joined.select(*rows.columns, *[found[c].alias(c) for c in added])


def cut(rows: DataFrame, key: str, order: list[Column], name: str, stats: DataFrame | None = None,
        floor: int | None = None, slice_rows: int | None = None, most: int | None = None,
        some: Column | None = None) -> DataFrame:
    """Adds ``name``: the slice of a row of an oversized key, numbered from 0 in ``order``; -1 for every other row.

    ``order`` must tell a key's rows apart as far as slices matter; its columns sort null first.
    Cuts are places of a sample of the oversized keys' rows, about 2 * P in all, and
    are broadcast. ``stats`` has ``n_rows`` per key where it is known already;
    ``some`` is their ``any_oversized``, where the sample shall not be looked for in vain.
    """
    stats = key_counts(rows, key) if stats is None else stats.select(key, "n_rows")
    every = _EVERY if slice_rows is None else max(1, min(_EVERY, slice_rows))
    share = stats.agg(F.sum("n_rows").alias("n")).scalar() / F.lit(2.0 * _partitions(rows))
    size = F.lit(float(slice_rows)) if slice_rows is not None else share if most is None else F.least(share, F.lit(float(most)))
    few = heaviest(stats, key, floor=floor, most=most).select(F.col(key).alias("_cut_key"), size.alias("_cut_size"))
    at = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)])
    taken = F.pmod(F.xxhash64("_cut_at"), F.lit(1 << 30)) * F.col("_cut_size") < F.lit(float(every << 30))
    sample = (rows if some is None else rows.where(some)).select(F.col(key).alias("_cut_row"), at.alias("_cut_at")).join(
        F.broadcast(few), F.col("_cut_row") == F.col("_cut_key")).where(taken)
    step = F.greatest(F.lit(every), F.ceil(F.size("_cut_at") / (MOST_SLICES - 1)).cast("int"))
    cuts = sample.groupBy("_cut_key").agg(F.sort_array(F.collect_set("_cut_at")).alias("_cut_at")).select(
        "_cut_key", F.filter("_cut_at", lambda _, i: i % step == step - 1).alias("_cuts"))
    marked = rows.join(F.broadcast(cuts), F.col(key) == F.col("_cut_key"), "left")
    passed = F.size(F.filter("_cuts", lambda c: c <= at))
    return marked.withColumn(name, F.when(F.col("_cut_key").isNotNull(), passed).otherwise(F.lit(-1))).drop("_cut_key", "_cuts")
