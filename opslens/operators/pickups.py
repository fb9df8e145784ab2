"""Pickup visits: slot labels and the pickup funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import (
    bit_if, differs, has_bit, has_text, holds, label_bit, long_metrics, not_in, null_if_zero, or_zero, ratio, with_reason_rank,
)
from ..functions.labels import (
    CANCELLED_LATER, CANCELLED_STEPS, CREATION_LATER, CREATION_STEPS, FUNNEL_STATUSES, PICKUP_DONE_LATER,
    PICKUP_DONE_STEPS, PICKUP_KEPT_REASONS, PICKUP_REASON_RULES,
)
from ..functions.text import merge_prefix, normalise_reason, range_start
from ..functions.times import hours, in_period, slot_label, slot_start
from . import skew

NOT_HOME = "not_available_at_the_address"
NOT_HOME_SLOTS = [name for _, name in CANCELLED_STEPS] + [CANCELLED_LATER]
LATE_SLOTS = ["t+2-t+3", ">t+3"]
CREATION_SLOTS = [name for _, name in CREATION_STEPS] + [CREATION_LATER]


def visit_slot(visits: DataFrame) -> DataFrame:
    """Add the slot start, and where the update and the creation fall relative to it.

    A visit that is neither done nor cancelled has no labels.
    """
    v = visits.withColumn("slot", slot_start(
        F.to_date("requested_date"), range_start(F.col("requested_time"))))
    done, cancelled = F.col("visit_status") == "done", F.col("visit_status") == "cancelled"
    return v.withColumn(
        "updation_slot",
        F.when(done, slot_label(F.col("updation_time"), F.col("slot"), PICKUP_DONE_STEPS, PICKUP_DONE_LATER))
        .when(cancelled, slot_label(F.col("cancellation_time"), F.col("slot"), CANCELLED_STEPS, CANCELLED_LATER)),
    ).withColumn(
        "creation_slot",
        F.when(done | cancelled, slot_label(F.col("creation_time"), F.col("slot"), CREATION_STEPS, CREATION_LATER)))


# Positions of the flags kept per booking.
_HOME = len(PICKUP_KEPT_REASONS)
_BEFORE = _HOME + len(NOT_HOME_SLOTS)
_WITHIN = _BEFORE + 1
_LATE = _WITHIN + 1
_MADE = _LATE + len(LATE_SLOTS)


def _booking_flags(visits: DataFrame) -> DataFrame:
    """Everything the funnel needs to know of a booking's visits, one row per booking.

    Distinct-booking counts turn into sums of flags, so that no distinct
    aggregate is expanded per metric, and a booking with very many visits is
    folded map-side.
    """
    done = F.col("visit_status") == "done"
    reason, late_by = F.col("visit_cancel_reason"), F.col("updation_time") - F.col("slot")
    late = done & (late_by > hours(2))
    not_home = (F.col("visit_status") == "cancelled") & (reason == NOT_HOME)
    flags = (
        label_bit(reason, PICKUP_KEPT_REASONS, 0)
        .bitwiseOR(bit_if(not_home, label_bit(F.col("updation_slot"), NOT_HOME_SLOTS, _HOME)))
        .bitwiseOR(bit_if(done, F.when(late_by < hours(0), F.lit(1 << _BEFORE))
                          .when(late_by <= hours(2), F.lit(1 << _WITHIN)).otherwise(F.lit(0))))
        .bitwiseOR(bit_if(late, label_bit(F.col("updation_slot"), LATE_SLOTS, _LATE).bitwiseOR(
            label_bit(F.col("creation_slot"), CREATION_SLOTS, _MADE)))))
    return visits.groupBy("booking_id").agg(
        F.countDistinct(F.when(not_in(reason, PICKUP_KEPT_REASONS), reason)).alias("other_reasons"),
        F.bit_or(flags).alias("flags"),
        F.count_if(holds(late & (F.col("creation_slot") == CREATION_LATER))).alias("late_made"))


def pickup_funnel(bookings: DataFrame, visits: DataFrame, start, end, city: str | None = None) -> DataFrame:
    """Requested bookings and where they were lost, each over the requested ones.

    Rows are ``(ord, metric, value)``: ``ord`` follows the order of the report,
    and the labels of one section share it. A listed label nothing falls under
    is null. The last row is the absolute number of requested bookings.
    """
    known = bookings.select("booking_id", "status", "cancel_reason", "cancelled_pickup_visits")
    asked = bookings.where(in_period(F.col("requested_date"), start, end, 0))
    seen = visits.where(in_period(F.col("requested_date"), start, end, 0))
    if city is not None:
        asked, seen = asked.where(F.col("city") == city), seen.where(F.col("city") == city)
    asked = asked.where(F.col("status").isin(FUNNEL_STATUSES))
    seen = visit_slot(seen.withColumn(
        "visit_cancel_reason", normalise_reason(F.col("visit_cancel_reason"), PICKUP_REASON_RULES)))

    cpv, cause = F.col("cancelled_pickup_visits"), F.col("cancel_reason")
    idle = (F.col("status") == "cancelled") & not_in(cause, ["reschedule_stock_out", "stock_out"]) & (cpv == 0)
    named = ["customer_cancellation", "reschedule", "out_of_geographical_area"]
    # One fold of the bookings serves their counts, their reasons and the divisor.
    folded_asked = skew.built_once(asked.groupBy(
        "booking_id",
        F.when(idle, merge_prefix(cause, "reschedule")).alias("cause"),
        F.when(idle, F.col("booking_cancel_reason")).alias("metric"),
        holds(has_text(cause, "stock_out") & (cpv == 0)).alias("stocked_out"),
    ).agg(F.count("booking_id").alias("n_rows")))

    def rows_where(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n_rows"))), F.lit(0)).alias(name)

    by_booking = folded_asked.agg(
        F.countDistinct("booking_id").alias("requested"),
        rows_where(F.col("cause") == "reschedule", "reschedule"),
        rows_where(F.col("cause") == "out_of_geographical_area", "area"),
        rows_where(~F.col("cause").isin(named), "others"),
        rows_where(F.col("stocked_out"), "pre_visit"))
    by_reason = folded_asked.groupBy("metric").agg(
        F.sum(F.when(F.col("metric").isNotNull(), F.col("n_rows"))).cast("double").alias("value")
    ).where(F.col("value") > 0)

    # Visits are folded to one row per booking before they meet the bookings.
    folded = _booking_flags(seen).join(known, "booking_id")
    stocked_out = has_text(cause, "stock_out")
    lost = (F.col("status") == "cancelled") & ~stocked_out
    once = holds(lost & (cpv == 1))

    def bookings_with(condition: Column, name: str) -> Column:
        return F.count_if(holds(condition)).alias(name)

    def flagged(condition: Column, first: int, labels: list[str], name: str) -> list[Column]:
        return [bookings_with(condition & has_bit(F.col("flags"), first + i), f"{name}_{i}")
                for i in range(len(labels))]

    always = F.lit(True)
    by_visit = folded.agg(
        bookings_with(stocked_out & differs(cpv, 0), "post_visit"),
        bookings_with(lost & (cpv >= 2), "ppvc2"),
        bookings_with(once, "ppvc1"),
        F.sum(F.when(once, F.col("other_reasons"))).alias("other_reasons"),
        *flagged(once, 0, PICKUP_KEPT_REASONS, "reason"),
        *flagged(once, _HOME, NOT_HOME_SLOTS, "home"),
        *flagged(always, _BEFORE, ["before", "within"], "timely"),
        *flagged(always, _LATE, LATE_SLOTS, "late"),
        *flagged(always, _MADE, CREATION_SLOTS, "made"),
        F.sum(F.when(cpv == 0, F.col("late_made"))).alias("late_single"))

    shares = (
        long_metrics(by_booking, [], [
            (1, "requested", F.col("requested")),
            (2, "out_of_geographical_area", F.col("area")),
            (2, "reschedule", F.col("reschedule")),
            (2, "others", F.col("others")),
            (4, "pre_visit_SO/RSO", F.col("pre_visit")),
            (16, "Requested_abs", F.col("requested")),
        ])
        .unionByName(by_reason.select(F.lit(3).alias("ord"), "metric", "value"))
        .unionByName(long_metrics(by_visit, [], [
            (5, "post_visit_SO/RSO", F.col("post_visit")),
            (6, "ppvc2", F.col("ppvc2")),
            (7, "ppvc1", F.col("ppvc1")),
            *[(8, r, null_if_zero(F.col(f"reason_{i}"))) for i, r in enumerate(PICKUP_KEPT_REASONS)],
            (9, "everything_else", or_zero(F.col("other_reasons"))),
            *[(10, s, null_if_zero(F.col(f"home_{i}"))) for i, s in enumerate(NOT_HOME_SLOTS)],
            (11, "before_slot_pikcup", F.col("timely_0")),  # spelled as in the report
            (12, "within_slot_pickup", F.col("timely_1")),
            *[(13, s, null_if_zero(F.col(f"late_{i}"))) for i, s in enumerate(LATE_SLOTS)],
            *[(14, s, null_if_zero(F.col(f"made_{i}"))) for i, s in enumerate(CREATION_SLOTS)],
            (15, "bookings_with_creation_time>t+1_single_visit", or_zero(F.col("late_single"))),
        ]))
    )
    requested = folded_asked.agg(F.countDistinct("booking_id")).scalar().cast("double")
    return with_reason_rank(shares.withColumn(
        "value", F.when(F.col("ord") == 16, F.col("value")).otherwise(ratio(F.col("value"), requested))), ["ord"], [3])
