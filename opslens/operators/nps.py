"""Net promoter score and bad-rating reason reports.

Every report first aggregates the bookings to a table with one row per period
and raw value, map-side; all later steps run on that small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import null_if_zero, nps_split, present, ratio, to_wide
from ..functions.text import list_items


def nps_summary(bookings: DataFrame, keys: list[str], statuses: list[str] | None = None,
                min_size: int | None = None, min_mean: float | None = None) -> DataFrame:
    """Bookings, bookings with feedback and mean NPS per group.

    ``min_size`` and ``min_mean`` keep only groups strictly above them.
    """
    rows = bookings if statuses is None else bookings.where(F.col("status").isin(statuses))
    out = present(rows, *keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"), F.count("nps").alias("count"), F.avg("nps").alias("mean"))
    if min_size is not None:
        out = out.where(F.col("size") > min_size)
    if min_mean is not None:
        out = out.where(F.col("mean") > min_mean)
    return out


def _reason_lists(bookings: DataFrame, *keys: str) -> DataFrame:
    """Bookings and feedback counted per key and raw reason list, nulls included."""
    return bookings.groupBy(*keys, "bad_rating_reason").agg(
        F.count("booking_id").alias("_n"), F.count("nps").alias("_scored"))


def _exploded(lists: DataFrame) -> DataFrame:
    return lists.withColumn("reason", F.explode(list_items(F.col("bad_rating_reason"))))


def _with_total(lists: DataFrame, value: str, period: str, name: str) -> DataFrame:
    """Adds the total of each period: an aggregate with one row per period, joined back."""
    total = lists.groupBy(period).agg(F.sum(value).alias(name))
    return lists.join(total, period)


def reason_share(bookings: DataFrame, period: str = "booking_month",
                 statuses: list[str] | None = None) -> DataFrame:
    """Mentions of each bad-rating reason over all feedback of the period."""
    rows = bookings if statuses is None else bookings.where(F.col("status").isin(statuses))
    lists = _with_total(_reason_lists(present(rows, period), period), "_scored", period, "feedbacks")
    mentions = _exploded(lists).groupBy(period, "reason", "feedbacks").agg(F.sum("_n").alias("mentions"))
    return mentions.select(
        period, "reason", "mentions", "feedbacks", ratio(F.col("mentions"), F.col("feedbacks")).alias("share"))


def reason_counts(bookings: DataFrame, period: str = "week") -> DataFrame:
    """Mentions by period, reason and feedback value."""
    lists = _reason_lists(present(bookings, period, "feedback"), period, "feedback")
    return _exploded(lists).groupBy(period, "reason", "feedback").agg(F.sum("_n").alias("mentions"))


def nps_weekly(bookings: DataFrame, period: str = "week") -> DataFrame:
    """Shares of detractors, neutrals and promoters among scored bookings, and NPS.

    A score nobody gave in a period has no share, and NPS needs both ends.
    """
    def share(score):
        return ratio(null_if_zero(F.count_if(F.col("nps") == score)), F.count("nps"))

    out = present(bookings, period).groupBy(period).agg(
        share(-1).alias("detractors"), share(0).alias("neutrals"), share(1).alias("promoters"),
        F.count("booking_id").alias("requested"), F.count("nps").alias("feedbacks"))
    return out.select(
        period, "detractors", "neutrals", "promoters",
        (F.col("promoters") - F.col("detractors")).alias("nps"),
        "requested", "feedbacks",
        ratio(100 * F.col("feedbacks"), F.col("requested")).alias("response_pct"))


def reason_pct(bookings: DataFrame, reasons: list[str], period: str = "week", wide: bool = False) -> DataFrame:
    """Listed reasons as a percentage of all bookings of the period, split by sentiment."""
    rows = present(bookings, period).withColumn("nps_split", nps_split(F.col("nps")))
    lists = _with_total(_reason_lists(rows, period, "nps_split"), "_n", period, "requested")
    mentions = (
        _exploded(lists).where(F.col("reason").isin(reasons))
        .groupBy("nps_split", period, "reason", "requested").agg(F.sum("_n").alias("mentions")))
    out = mentions.select(
        "nps_split", period, "reason",
        ratio(F.col("mentions").cast("double"), F.col("requested") * 0.01).alias("pct"))
    return to_wide(out, ["nps_split", period], "reason", reasons, "pct") if wide else out


def good_localities(bookings: DataFrame, min_size: int = 5, min_nps: float = 0.10,
                    statuses: list[str] | None = None) -> DataFrame:
    """Localities with more than ``min_size`` bookings and a mean NPS above ``min_nps``."""
    return nps_summary(bookings, ["locality"], statuses, min_size, min_nps).select("locality")


def share_of_first(value: str, keys: list[str], order: str):
    """``value`` over the first one present of its group, by ``order``."""
    first = F.first(value, ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy(order).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))
    return ratio(F.col(value).cast("double"), first)
