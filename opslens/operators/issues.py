"""Support issues: response and resolution times, logistics and quality sub-reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import holds, not_in, null_if_zero, present, ratio, to_number, to_wide
from ..functions.labels import (
    CATEGORY_MAP, DELIVERY_L3_MAP, L2_MAP, L3_MAP, LOGISTICS_L2, OWNER_MAP, PICKUP_L3_MAP, QUALITY_CATEGORIES,
    QUALITY_L3_MAP, QUALITY_PRODUCTS, UNTIMED_L2,
)
from ..functions.text import relabel
from ..functions.times import Period, clock_seconds, days, in_period, moment, period_label
from . import skew
from .quantiles import distribution

# Business hours and the closed minutes between two business days.
OPENING_HOUR = 8
CLOSING_HOUR = 22
CLOSED_MINUTES = 600


def prepare_issues(issues: DataFrame) -> DataFrame:
    """Shorten the owner, sub-type and category labels."""
    return issues.withColumns({
        "owner": relabel(F.col("owner"), OWNER_MAP),
        "l2_subtype": relabel(F.col("l2_subtype"), L2_MAP),
        "l3_subtype": relabel(F.col("l3_subtype"), L3_MAP),
        "category": relabel(F.col("category"), CATEGORY_MAP),
    })


def with_period(df: DataFrame, col: str, periods: list[Period], default: str | None = None,
                end_days: int = 1) -> DataFrame:
    """Keep the rows of the periods' whole span and add their ``week`` label."""
    inside = in_period(F.col(col), periods[0][1], periods[-1][2], end_days)
    return df.where(inside).withColumn("week", period_label(F.col(col), periods, default, end_days))


def business_frt(issues: DataFrame, periods: list[Period]) -> DataFrame:
    """First response time in minutes of business hours, in ``first_response_min``.

    An issue opened outside business hours starts at the next opening. Each date
    boundary between start and response takes the closed minutes off; a response
    before the start gives them back. The week is that of the original creation,
    and ``created_at`` moves to the start.
    """
    rows = with_period(issues.withColumn("_m", to_number(F.col("first_response_min"))), "created_at", periods)
    created, hour = F.col("created_at"), F.hour("created_at")
    opening = F.make_dt_interval(F.lit(0), F.lit(OPENING_HOUR))
    midnight = F.to_date("created_at").cast("timestamp_ntz")
    start = (
        F.when(hour >= CLOSING_HOUR, midnight + days(1) + opening)
        .when(hour < OPENING_HOUR, midnight + opening)
        .otherwise(created))
    rows = rows.withColumn("_start", start).withColumn(
        "_m", F.col("_m") - clock_seconds(created, F.col("_start")) / F.lit(60.0))
    answered = F.col("_start") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.round(F.col("_m") * 60, 6).cast("decimal(18,6)"))
    nights = F.datediff(answered, F.col("_start"))
    return rows.withColumn("first_response_min", F.col("_m") - CLOSED_MINUTES * nights).withColumn(
        "created_at", F.col("_start")).drop("_m", "_start")


def sourced(frt: DataFrame) -> DataFrame:
    """Answered issues that came in through a source."""
    return frt.where(F.col("source").isNotNull() & F.col("first_response_min").isNotNull())


def owned_logistics(frt: DataFrame, owners: list[str], closers: list[str]) -> DataFrame:
    """Answered pickup and delivery issues closed in an owner team or by a listed closer."""
    mine = holds(F.col("owner").isin(owners)) | holds(F.col("closed_by").isin(closers))
    return frt.where(F.col("first_response_min").isNotNull() & F.col("l2_subtype").isin(LOGISTICS_L2) & mine)


def frt_kpis(frt: DataFrame, period: str = "week") -> DataFrame:
    """Percentage of issues answered within 20 and 60 business minutes, one decimal."""
    minutes = F.col("first_response_min")

    def pct(limit):
        return F.round(ratio(100.0 * null_if_zero(F.count_if(minutes <= limit)), F.count(minutes)), 1)

    return present(frt, period).groupBy(period).agg(
        F.count(minutes).alias("issues"), pct(20).alias("within_20_pct"), pct(60).alias("within_60_pct"))


def frt_distribution(frt: DataFrame, keys: list[str]) -> DataFrame:
    return distribution(frt, keys, "first_response_min")


def resolution_time(issues: DataFrame, periods: list[Period], start, end) -> DataFrame:
    """Hours to close by sub-type and week, for inactive issues closed from ``start`` to ``end``.

    Some sub-types are left out, by their original spelling; labels are lower-cased after.
    """
    closed = issues.where(
        not_in(F.col("l2_subtype"), UNTIMED_L2)
        & in_period(F.col("closed_at"), start, end)
        & holds(F.col("active") == False)  # noqa: E712
    ).withColumns({
        "l2_subtype": F.lower("l2_subtype"),
        "week": period_label(F.col("closed_at"), periods),
        "hours": to_number(F.col("hours_to_close")),
    })
    return distribution(closed, ["l2_subtype", "week"], "hours")


def _share_within(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Percentage of each label within its group; issues without label count in the total."""
    counts = present(rows, *keys).groupBy(*keys, label).agg(F.count("issue_id").alias("issues"))
    counts = counts.withColumn("total", F.sum("issues").over(Window.partitionBy(*keys)))
    return present(counts, label).select(
        *keys, label, "issues", "total", ratio(100.0 * F.col("issues"), F.col("total")).alias("pct"))


def inactive_in(issues: DataFrame, col: str, periods: list[Period], start=None, end=None) -> DataFrame:
    """Inactive issues dated within the periods (or a narrower span), with their week."""
    lo, hi = start or periods[0][1], end or periods[-1][2]
    rows = issues.where(in_period(F.col(col), lo, hi) & holds(F.col("active") == False))  # noqa: E712
    return rows.withColumn("week", period_label(F.col(col), periods))


def issue_share(issues: DataFrame, periods: list[Period]) -> DataFrame:
    """Old taxonomy: sub-reasons of pickup and delivery issues as a percentage of the week, by closing date."""
    rows = inactive_in(issues, "closed_at", periods).where(
        F.col("l2_subtype").isin(LOGISTICS_L2) & F.col("source").isNotNull())
    reason = relabel(F.col("l3_subtype"), PICKUP_L3_MAP)
    reason = F.when(F.col("l2_subtype") == "delivery", relabel(reason, DELIVERY_L3_MAP)).otherwise(reason)
    return _share_within(rows.withColumn("l3_subtype", reason), ["l2_subtype", "week"], "l3_subtype")


def unexplained_pickups(issues: DataFrame, periods: list[Period]) -> DataFrame:
    """The pickup issues of ``issue_share`` filed under 'Others', row by row."""
    return inactive_in(issues, "closed_at", periods).where(
        (F.col("l2_subtype") == "pickup") & F.col("source").isNotNull()
        & (relabel(F.col("l3_subtype"), PICKUP_L3_MAP) == "Others"))


def with_requested_date(issues: DataFrame, bookings: DataFrame, heavy_rows: int | None = None) -> DataFrame:
    """Issues of known bookings with the booking's requested date."""
    dates = bookings.select("booking_id", "requested_date", F.lit(True).alias("_known"))
    found = skew.lookup(present(issues, "booking_id"), dates, "booking_id", F.col("issue_id"), floor=heavy_rows)
    return found.where(F.col("_known")).drop("_known")


def issue_share_by_request(issues: DataFrame, periods: list[Period], start=None, end=None) -> DataFrame:
    """New taxonomy: sub-reasons of Pickup and Delivery issues as a percentage of the week, by requested date."""
    rows = inactive_in(issues, "requested_date", periods, start, end).where(
        F.col("l1_subtype").isin("Pickup", "Delivery") & F.col("source").isNotNull())
    return _share_within(rows, ["l1_subtype", "week"], "l3_subtype")


def issue_share_wide(shares: DataFrame, weeks: list[str], level: str) -> DataFrame:
    """One row per sub-reason, one column per week."""
    return to_wide(shares, [level, "l3_subtype"], "week", weeks, "pct")


def quality_counts(issues: DataFrame, periods: list[Period], wide: bool = True) -> DataFrame:
    """Old taxonomy: quality issues by sub-reason letter and week, one column per category."""
    rows = inactive_in(issues, "closed_at", periods).where(
        (F.col("l2_subtype") == "Quality") & F.col("category").isin(QUALITY_CATEGORIES)
    ).withColumn("l3_subtype", relabel(F.col("l3_subtype"), QUALITY_L3_MAP))
    counts = present(rows, "l3_subtype").groupBy("l3_subtype", "category", "week").agg(
        F.count("issue_id").alias("issues"))
    return to_wide(counts, ["l3_subtype", "week"], "category", QUALITY_CATEGORIES, "issues") if wide else counts


def quality_counts_by_request(issues: DataFrame, periods: list[Period], floor=None,
                              wide: bool = False) -> DataFrame:
    """New taxonomy: wash-quality issues by product, sub-reason and week of the requested date, active ones too."""
    rows = issues.where(in_period(F.col("requested_date"), periods[0][1], periods[-1][2]))
    if floor is not None:
        rows = rows.where(F.col("requested_date") >= moment(floor))
    rows = rows.withColumn("week", period_label(F.col("requested_date"), periods)).where(
        (F.col("l1_subtype") == "Wash quality") & F.col("l2_subtype").isin(QUALITY_PRODUCTS))
    counts = present(rows, "l3_subtype").groupBy(F.col("l2_subtype").alias("product"), "l3_subtype", "week").agg(
        F.count("issue_id").alias("issues"))
    weeks = [name for name, _, _ in periods]
    return to_wide(counts, ["product", "l3_subtype"], "week", weeks, "issues") if wide else counts
