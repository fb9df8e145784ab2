"""Courier productivity and third-party courier extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import differs, holds, null_if_zero
from ..functions.labels import COURIER_STATUSES
from ..functions.text import clean_name
from ..functions.times import day_of, month_of


def courier_productivity(bookings: DataFrame, month: str, statuses: list[str] = COURIER_STATUSES) -> DataFrame:
    """Pickups and deliveries per courier and day of ``month``; a side without work stays null.

    A booking contributes a pickup record and a delivery record in one pass, so
    both sides come out of a single aggregation.
    """
    rows = bookings.where(F.col("status").isin(statuses) & F.col("booking_id").isNotNull())

    def record(who, when, pickup):
        return F.when(
            holds(month_of(F.col(when)) == month) & F.col(who).isNotNull(),
            F.struct(clean_name(F.col(who)).alias("sp"), day_of(F.col(when)).alias("date"),
                     F.lit(pickup).alias("pickup")))

    records = F.array_compact(F.array(
        record("pickup_by", "requested_date", True),
        record("delivery_by", "delivery_scheduled_time", False)))
    return rows.select(F.inline(records)).groupBy("sp", "date").agg(
        null_if_zero(F.count_if("pickup")).alias("pickups"),
        null_if_zero(F.count_if(~F.col("pickup"))).alias("deliveries"))


def courier_extract(bookings: DataFrame, month: str, delivery_by: list[str], pickup_by: list[str]) -> DataFrame:
    """Bookings handled by the listed couriers, one output row per (role, courier).

    Deliveries are limited to the month they were scheduled for, and say the day;
    pickups are not.
    Write it with ``sinks.write_by_group(df, path, ["role", "courier"])``.
    """
    rows = (
        bookings.where(differs(F.col("status"), "cancelled"))
        .withColumn("delivery_by", clean_name(F.col("delivery_by")))
        .withColumn("pickup_by", clean_name(F.col("pickup_by")))
    )
    delivered = holds(F.col("delivery_by").isin(delivery_by)
                      & (month_of(F.col("delivery_scheduled_time")) == month))
    picked = holds(F.col("pickup_by").isin(pickup_by))
    roles = F.array_compact(F.array(
        F.when(delivered, F.struct(F.lit("delivery").alias("role"), F.col("delivery_by").alias("courier"))),
        F.when(picked, F.struct(F.lit("pickup").alias("role"), F.col("pickup_by").alias("courier")))))
    day = F.when(F.col("role") == "delivery", F.to_date("delivery_scheduled_time"))
    return rows.select("*", F.inline(roles)).withColumn("delivery_date", day)


def first_rows(report: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first rows of a report in the given order."""
    return report.orderBy(*order).limit(n)
