"""Every operator as a query over the whole test tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.functions.columns import nps_score
from opslens.functions.labels import COMPLETED_STATUSES, LOGISTICS_REASONS, QUALITY_REASONS, SERVICE_REASONS
from opslens.functions.times import iso_week_label, month_of, period_label, step_week_label
from opslens.operators import bookings as B
from opslens.operators import calls as C
from opslens.operators import cohorts as K
from opslens.operators import couriers as R
from opslens.operators import customers as U
from opslens.operators import deliveries as D
from opslens.operators import issues as I
from opslens.operators import nps as N
from opslens.operators import periods as W
from opslens.operators import pickups as P
from opslens.plans import stored as S
from opslens.sources import adapters as A
from opslens.sources.sinks import stack_reports

Query = Callable[[SparkSession, str], DataFrame]

# Periods that cover every row of the test tables: years of bookings, parts of the events' month.
YEARS = [(f"W{i + 1}", dt.date(1995 + i, 1, 1), dt.date(1995 + i, 12, 31)) for i in range(7)] + [
    ("W8", dt.date(2002, 1, 1), dt.date(2003, 12, 31))]
EVENT_WEEKS = [
    ("W5", dt.date(2024, 1, 1), dt.date(2024, 1, 8)),
    ("W6", dt.date(2024, 1, 9), dt.date(2024, 1, 16)),
    ("W7", dt.date(2024, 1, 17), dt.date(2024, 1, 24)),
    ("W8", dt.date(2024, 1, 25), dt.date(2024, 2, 28)),
]
# Every month of the bookings.
MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13)]
SNAPSHOTS = [(f"{y}-{m:02d}-01", f"{y if m > 1 else y - 1}-{m - 1 if m > 1 else 12:02d}")
             for y in (1996, 1998, 2000) for m in (1, 7)]
STEP_START = dt.date(1998, 6, 1)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _priced(spark, d):
    return B.with_revenue(A.bookings(spark, d))


def _enriched(spark, d):
    """Enriched bookings for the reports that do not look at duplicates."""
    return B.enrich_customers(_priced(spark, d), duplicates=False)


def _scored(spark, d):
    return A.bookings(spark, d).withColumn("nps", nps_score(F.col("feedback"))).withColumn(
        "booking_month", month_of(F.col("requested_date")))


def _by_year(spark, d):
    return _scored(spark, d).withColumn("week", period_label(F.col("requested_date"), YEARS, end_days=0))


def _calls(spark, d):
    return C.prepare_calls(A.calls(spark, d), A.agents(spark, d), EVENT_WEEKS[0][1], EVENT_WEEKS[-1][2])


def _callbacks(spark, d):
    return C.callback_status(_calls(spark, d)).withColumn(
        "week", period_label(F.col("start_time"), EVENT_WEEKS))


def _issues(spark, d):
    return I.prepare_issues(A.issues(spark, d))


def _frt(spark, d):
    return I.business_frt(_issues(spark, d), EVENT_WEEKS)


def _requested_issues(spark, d):
    return I.with_requested_date(_issues(spark, d), A.bookings(spark, d))




def boxed(df: DataFrame) -> DataFrame:
    """Means are sums of inexact numbers in any order: nine digits leave no half to round either way."""
    return rounded(rounded(df, "mean", digits=9), "p10", "p25", "p50", "p75", "p80", "p90")


ENRICHED = [
    "booking_id", "phone", "status", "requested_date", "booking_month", "total_revenue", "amp",
    "customer_credits", "successful_bookings", "cohort_group", "acquisition_source", "customer_segment",
    "only_dc", "booking_count", "rating", "duplicate_booking", "new_repeat", "nps",
]
SHARES = ["users_share", "bookings_share", "revenue_share"]


def _period_labels(spark, d):
    day = F.col("requested_date")
    return A.bookings(spark, d).groupBy(
        period_label(day, YEARS[:4]).alias("first_match"),
        period_label(day, YEARS, end_days=0).alias("inclusive"),
        step_week_label(day, STEP_START).alias("stepped"),
        iso_week_label(day).alias("iso_week"),
    ).agg(F.count(F.lit(1)).alias("bookings"))


def _stored_reports(spark, d):
    """Four reports from one stored table of customer histories."""
    kept = S.store(S.histories(_enriched(spark, d)), f"customer_histories_{uuid.uuid4().hex}")
    return stack_reports({
        "cohort_matrix": rounded(S.cohort_matrix(kept), *SHARES),
        "cohort_variants": rounded(S.cohort_variants(kept, excluded=["1995-01"]), *SHARES),
        "core_customers": rounded(S.core_customers(kept, SNAPSHOTS), "core_share", "core_gmv_share"),
        "marketing_master": rounded(S.marketing_master(kept, as_of="2001-08-15"), "avg_feedback"),
    }, "report")


QUERIES: dict[str, Query] = {
    "stored_reports": _stored_reports,
    "merge_bookings": lambda s, d: B.merge_bookings(*A.booking_dumps(s, d)),
    "merge_dumps": lambda s, d: B.merge_dumps(A.more_dumps(s, d)),
    "booking_revenue": lambda s, d: _priced(s, d).withColumn("actual_paid", B.actual_paid()).select(
        "booking_id", "booking_month", "discount_amount", "taxes", "credits_used", "total_revenue", "amp",
        "actual_paid"),
    "acquisition_source": lambda s, d: B.acquisition_source(A.bookings(s, d)),
    "customer_segment": lambda s, d: B.customer_segment(A.bookings(s, d)),
    "customer_rating": lambda s, d: B.customer_rating(_priced(s, d)),
    "latest_credits": lambda s, d: B.latest_credits(A.bookings(s, d)),
    "duplicate_flag": lambda s, d: B.duplicate_flag(A.bookings(s, d)).select(
        "booking_id", "phone", "parent_id", "duplicate_booking"),
    "enrich_customers": lambda s, d: B.enrich_customers(_priced(s, d)).select(ENRICHED),
    "booking_count_dump_order": lambda s, d: B.enrich_customers(
        _priced(s, d), order_by=("booking_id",), duplicates=False).select("booking_id", "phone", "booking_count"),
    "nps_by_month": lambda s, d: rounded(N.nps_summary(_scored(s, d), ["booking_month"], COMPLETED_STATUSES), "mean"),
    "nps_by_month_city": lambda s, d: rounded(
        N.nps_summary(_scored(s, d), ["booking_month", "city"], COMPLETED_STATUSES), "mean"),
    "nps_by_week": lambda s, d: rounded(N.nps_summary(_by_year(s, d), ["week"]), "mean"),
    "good_localities": lambda s, d: rounded(
        N.nps_summary(_scored(s, d), ["locality"], COMPLETED_STATUSES, 5, 0.10), "mean"),
    "reason_share": lambda s, d: rounded(N.reason_share(_scored(s, d), "booking_month", COMPLETED_STATUSES), "share"),
    "reason_counts": lambda s, d: N.reason_counts(_by_year(s, d), "week"),
    "nps_weekly": lambda s, d: rounded(
        N.nps_weekly(_by_year(s, d)), "detractors", "neutrals", "promoters", "nps", "response_pct"),
    "nps_iso_weekly": lambda s, d: rounded(
        N.nps_weekly(_scored(s, d).withColumn("week", iso_week_label(F.col("requested_date")))),
        "detractors", "neutrals", "promoters", "nps", "response_pct"),
    "reason_pct_service": lambda s, d: rounded(N.reason_pct(_by_year(s, d), SERVICE_REASONS), "pct"),
    "reason_pct_quality": lambda s, d: rounded(N.reason_pct(_by_year(s, d), QUALITY_REASONS), "pct"),
    "reason_pct_logistics_wide": lambda s, d: rounded(
        N.reason_pct(_by_year(s, d), LOGISTICS_REASONS, wide=True), *LOGISTICS_REASONS),
    "cohort_matrix": lambda s, d: rounded(K.cohort_matrix(_enriched(s, d)), *SHARES),
    "cohort_users_wide": lambda s, d: K.cohort_wide(K.cohort_matrix(_enriched(s, d)), "users", MONTHS),
    "cohort_variants": lambda s, d: rounded(K.cohort_variants(_enriched(s, d), excluded=["1995-01"]), *SHARES),
    "cohorts_for_good_localities": lambda s, d: rounded(
        K.cohorts_for_good_localities(A.bookings(s, d), excluded_month="1999-06"), *SHARES),
    "pickup_visit_slots": lambda s, d: P.visit_slot(A.pickup_visits(s, d)).groupBy(
        "visit_status", "updation_slot", "creation_slot").agg(F.count(F.lit(1)).alias("visits")),
    "pickup_funnel": lambda s, d: rounded(
        P.pickup_funnel(A.bookings(s, d), A.pickup_visits(s, d), "1995-01-01", "2003-12-31"), "value"),
    "assign_ofd": lambda s, d: D.assign_ofd(A.delivery_visits(s, d)).select(
        "booking_id", "visit_id", "ofd_happened_at", "ofd_time", "ofd_attempts"),
    "delivery_funnel": lambda s, d: rounded(
        D.delivery_funnel(A.delivery_visits(s, d), "1995-01-01", "2003-12-31", STEP_START), "value"),
    "delivery_funnel_v1": lambda s, d: rounded(
        D.delivery_funnel_v1(A.delivery_visits(s, d), "1995-01-01", "2003-12-31"), "value"),
    "prepare_calls": _calls,
    "callback_status": lambda s, d: rounded(_callbacks(s, d), "callback_minutes").select(
        "call_id", "phone", "week", "callback_status", "callback_minutes"),
    "callback_kpis": lambda s, d: rounded(
        C.callback_kpis(_callbacks(s, d)), "missed_pct"),
    "callback_distribution": lambda s, d: boxed(C.callback_distribution(_callbacks(s, d))),
    "handling_time": lambda s, d: boxed(C.handling_time(
        _calls(s, d).withColumn("week", period_label(F.col("start_time"), EVENT_WEEKS)))),
    "business_frt": lambda s, d: rounded(_frt(s, d), "first_response_min").select(
        "issue_id", "week", "created_at", "first_response_min"),
    "frt_kpis": lambda s, d: I.frt_kpis(I.sourced(_frt(s, d))),
    "frt_distribution": lambda s, d: boxed(I.frt_distribution(I.sourced(_frt(s, d)), ["week"])),
    "frt_distribution_logistics": lambda s, d: boxed(I.frt_distribution(
        I.owned_logistics(_frt(s, d), ["mumbai"], ["agent_3", "agent_7"]), ["l2_subtype", "week"])),
    "resolution_time": lambda s, d: boxed(
        I.resolution_time(_issues(s, d), EVENT_WEEKS, "2024-01-01", "2024-02-28")),
    "issue_share": lambda s, d: rounded(I.issue_share(_issues(s, d), EVENT_WEEKS), "pct"),
    "issue_share_wide": lambda s, d: rounded(I.issue_share_wide(
        I.issue_share(_issues(s, d), EVENT_WEEKS), ["W5", "W6", "W7", "W8"], "l2_subtype"), "W5", "W6", "W7", "W8"),
    "unexplained_pickups": lambda s, d: I.unexplained_pickups(_issues(s, d), EVENT_WEEKS).select(
        "issue_id", "week", "l3_subtype", "source"),
    "issue_share_by_request": lambda s, d: rounded(I.issue_share_by_request(_requested_issues(s, d), YEARS), "pct"),
    "quality_counts": lambda s, d: I.quality_counts(_issues(s, d), EVENT_WEEKS).withColumnsRenamed({
        "Dry Cleaning and Special Care": "dry_cleaning", "Wash and Iron by weight": "by_weight",
        "Wash and Iron Prime": "prime"}),
    "quality_counts_by_request": lambda s, d: I.quality_counts_by_request(
        _requested_issues(s, d), YEARS, "1996-01-01"),
    "core_customers": lambda s, d: rounded(
        U.core_customers(_enriched(s, d), SNAPSHOTS), "core_share", "core_gmv_share"),
    "core_customers_as_reported": lambda s, d: rounded(
        U.core_customers(_enriched(s, d), SNAPSHOTS, fix_dc=False), "core_share", "core_gmv_share"),
    "customer_profile": lambda s, d: rounded(
        U.customer_profile(A.bookings(s, d), "2002-01-01"),
        *[f"{m}{x}" for m in U.PROFILE_METRICS for x in ("", "_lo", "_hi")]),
    "marketing_master": lambda s, d: rounded(
        U.marketing_master(_enriched(s, d), as_of="2001-08-15"), "avg_feedback"),
    "leads_without_bookings": lambda s, d: U.leads_without_bookings(A.leads(s, d), A.bookings(s, d)),
    "courier_productivity": lambda s, d: R.courier_productivity(A.bookings(s, d), "1998-07"),
    "courier_extract": lambda s, d: R.courier_extract(
        A.bookings(s, d), "1998-07", [f"sp {i}" for i in range(20)], ["sp 3", "sp 8"]).select(
        "role", "courier", "booking_id", "locality", "status", "requested_date", "delivery_scheduled_time",
        "delivery_date"),
    "courier_first_rows": lambda s, d: R.first_rows(
        R.courier_productivity(A.bookings(s, d), "1998-07"), ["sp", "date"], 10),
    "period_labels": _period_labels,
    "period_table": lambda s, d: W.with_period(
        A.bookings(s, d).select("booking_id", "requested_date"), "requested_date", A.periods(s, d), "campaign",
        default="none", spread=F.col("booking_id")),
}
