"""The report chains that run several operators as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.bookings import enrich_customers, merge_bookings, with_revenue
from ..operators.calls import callback_distribution, callback_kpis, callback_status, handling_time, prepare_calls
from ..operators.cohorts import cohort_variants
from ..operators.issues import business_frt, frt_distribution, frt_kpis, sourced
from ..operators.nps import nps_summary, reason_share
from ..functions.labels import COMPLETED_STATUSES
from ..functions.times import Period, period_label
from pyspark.sql import functions as F


def enriched_bookings(newer: DataFrame, older: DataFrame, **options) -> DataFrame:
    """Two dumps merged, priced and enriched with their customers' columns."""
    return enrich_customers(with_revenue(merge_bookings(newer, older)), **options)


def monthly_business_report(enriched: DataFrame, city: str | None = None) -> dict[str, DataFrame]:
    """NPS by month and by city, bad-rating reasons and cohorts of enriched bookings."""
    return {
        "nps": nps_summary(enriched, ["booking_month"], COMPLETED_STATUSES),
        "nps_city": nps_summary(enriched, ["booking_month", "city"], COMPLETED_STATUSES),
        "bad_rating_analysis": reason_share(enriched, "booking_month", COMPLETED_STATUSES),
        "cohorts": cohort_variants(enriched, city),
    }


def call_centre_report(calls: DataFrame, agents: DataFrame, issues: DataFrame,
                       periods: list[Period]) -> dict[str, DataFrame]:
    """Callback, handling and response times of one call centre over the periods."""
    prepared = prepare_calls(calls, agents, periods[0][1], periods[-1][2])
    marked = callback_status(prepared).withColumn("week", period_label(F.col("start_time"), periods))
    frt = sourced(business_frt(issues, periods))
    return {
        "callback_kpis": callback_kpis(marked),
        "callback_time": callback_distribution(marked),
        "handling_time": handling_time(marked),
        "response_kpis": frt_kpis(frt),
        "response_time": frt_distribution(frt, ["week"]),
    }
