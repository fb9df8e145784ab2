"""Core customers, customer profiles, the marketing master and booking-less leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import differs, first_present, holds, present, ratio
from ..functions.labels import COMPLETED_STATUSES
from ..functions.times import moment, whole_days_between
from . import skew
from .bookings import actual_paid
from .quantiles import distribution

# Mean days between bookings below which a customer is core.
CORE_DAYS = 20
CORE_DAYS_DRY_CLEANING = 60

# Inactivity thresholds of the marketing master, in days.
INACTIVE_DAYS = [30, 45, 60, 75, 90]

#: A customer's first present value of each goes into the marketing master.
CONTACT_COLUMNS = ["customer_name", "email", "locality", "city", "rating", "customer_credits", "customer_segment"]


def core_customers(bookings: DataFrame, snapshots: list[tuple[str, str]],
                   statuses: list[str] = COMPLETED_STATUSES, fix_dc: bool = True) -> DataFrame:
    """Share of core customers, and of their revenue, per snapshot.

    ``snapshots`` are (date, month): a customer is judged on the bookings before
    the date and counted when one of those falls into the month. The customer's
    ``successful_bookings`` is the one ``enrich_customers`` wrote. With
    ``fix_dc=False`` dry-cleaning-only customers are never core.

    The time line is cut at the snapshot dates. Bookings are first folded to one state per
    customer, stretch between two dates and counted month, then to one row per customer, which
    reads the states up to each snapshot whose month it was active in. So the rows
    shuffled do not grow with the number of snapshots, and a customer's list of states is no
    longer than the stretches and counted months, however many bookings there are.
    """
    return core_shares(present(bookings.where(F.col("status").isin(statuses)), "phone"), F.col("requested_date"), [
        F.min("requested_date").alias("first"), F.sum("successful_bookings").alias("sum"),
        F.count("successful_bookings").alias("n"), F.bool_and(F.col("only_dc").isNotNull()).alias("dc"),
        F.sum("total_revenue").alias("gmv")], snapshots, fix_dc)


def core_shares(rows: DataFrame, day: Column, facts: list[Column], snapshots: list[tuple[str, str]],
                fix_dc: bool) -> DataFrame:
    """The report of ``core_customers`` from rows of named customers; ``facts`` fold rows into first, sum, n, dc and gmv."""
    dates = sorted({str(d) for d, _ in snapshots})
    months = sorted({m for _, m in snapshots})
    cuts = F.array(*[moment(d) for d in dates])
    listed = F.array(*[
        F.struct(moment(d).alias("as_of"), F.lit(m).alias("month"), F.lit(dates.index(str(d))).alias("at"))
        for d, m in snapshots])
    states = (
        rows.where(day < moment(dates[-1]))
        .groupBy("phone", F.size(F.filter(cuts, lambda c: c <= day)).alias("at"),
                 F.when(F.col("booking_month").isin(months), F.col("booking_month")).alias("month"))
        .agg(*facts)
        .groupBy("phone")
        .agg(F.collect_list(F.struct("at", "month", "first", "sum", "n", "dc", "gmv")).alias("_states"))
    )
    active = F.filter(listed, lambda s: F.exists("_states", lambda x: (x["at"] <= s["at"]) & (x["month"] == s["month"])))
    read = states.withColumn("_s", F.explode(active)).withColumn(
        "_past", F.filter("_states", lambda x: x["at"] <= F.col("_s.at")))

    def total(items, field, kind):
        return F.aggregate(items, F.lit(0).cast(kind), lambda a, x: a + F.coalesce(x[field], F.lit(0)).cast(kind))

    in_month = F.filter("_past", lambda x: (x["month"] == F.col("_s.month")) & x["gmv"].isNotNull())
    customers = read.select(
        "_s.as_of", "_s.month",
        F.array_min(F.col("_past.first")).alias("_first"),
        F.try_divide(total("_past", "sum", "double"), total("_past", "n", "bigint")).alias("_n"),
        F.forall("_past", lambda x: x["dc"]).alias("_dc"),
        F.when(F.size(in_month) > 0, total(in_month, "gmv", "double")).alias("_gmv"))
    gap = ratio(whole_days_between(F.col("_first"), F.col("as_of")).cast("double"), F.col("_n"))
    limit = F.when(F.col("_dc"), F.lit(CORE_DAYS_DRY_CLEANING)).otherwise(F.lit(CORE_DAYS))
    core = holds((gap < limit) & (F.col("_n") > 1))
    if not fix_dc:
        core = core & ~F.col("_dc")
    totals = customers.withColumn("_core", core).groupBy("as_of", "month").agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if("_core").alias("_core_users"),
        F.sum("_gmv").alias("gmv"),
        F.coalesce(F.sum(F.when(F.col("_core"), F.col("_gmv"))), F.lit(0.0)).alias("_core_gmv"))
    return totals.select(
        "as_of", "month", "users", ratio(F.col("_core_users"), F.col("users")).alias("core_share"),
        "gmv", ratio(F.col("_core_gmv"), F.col("gmv")).alias("core_gmv_share"))


PROFILE_METRICS = ["frequency", "avg_paid", "avg_revenue"]


def customer_profile(bookings: DataFrame, as_of=None, n: int = 5,
                     statuses: list[str] = COMPLETED_STATUSES) -> DataFrame:
    """Frequency, average paid and average revenue per customer, each cut into ``n`` equal-count buckets.

    Buckets are right-closed at the exact interpolated quantiles over all
    customers; equal values always share a bucket. ``*_lo`` / ``*_hi`` are the
    bucket's edges.
    """
    today = F.current_date().cast("timestamp_ntz") if as_of is None else moment(as_of)
    customers = (
        present(bookings.where(F.col("status").isin(statuses)), "phone").groupBy("phone")
        .agg(F.count("requested_date").alias("bookings"), F.min("requested_date").alias("_first"),
             F.sum(actual_paid()).alias("_paid"), F.sum("amount").alias("_revenue"))
        .select("phone", "bookings",
                ratio(whole_days_between(F.col("_first"), today).cast("double"), F.col("bookings")).alias("frequency"),
                ratio(F.col("_paid"), F.col("bookings")).alias("avg_paid"),
                ratio(F.col("_revenue"), F.col("bookings")).alias("avg_revenue"))
    )
    long = customers.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in PROFILE_METRICS])).alias("_m")
    ).select("_m.*")
    points = {f"e{i}": i / n for i in range(n + 1)}
    # One row with a fixed number of entries, one per profile metric.
    edges = distribution(long, ["metric"], "value", points).agg(F.map_from_entries(F.collect_list(
        F.struct("metric", F.array(*points)))).alias("edges"))
    out = customers.withColumn("_edges", edges.scalar())
    for m in PROFILE_METRICS:
        cuts = F.try_element_at(F.col("_edges"), F.lit(m))
        bucket = F.lit(n)
        for i in range(n - 1, 0, -1):
            bucket = F.when(F.col(m) <= F.get(cuts, F.lit(i)), F.lit(i)).otherwise(bucket)
        out = out.withColumn(f"{m}_bucket", F.when(F.col(m).isNotNull(), bucket))
        out = out.withColumn(f"{m}_lo", F.get(cuts, F.col(f"{m}_bucket") - 1))
        out = out.withColumn(f"{m}_hi", F.get(cuts, F.col(f"{m}_bucket")))
    return out.drop("_edges")


def marketing_master(bookings: DataFrame, city: str | None = None, as_of=None,
                     days: list[int] = INACTIVE_DAYS) -> DataFrame:
    """One contact row per customer with bookings, last date and inactivity flags."""
    rows = bookings if city is None else bookings.where(F.col("city") == city)
    return contact_rows(present(rows, "phone"), [
        *[first_present(c, "booking_id").alias(c) for c in CONTACT_COLUMNS],
        F.avg("feedback").alias("avg_feedback"),
        F.count("requested_date").alias("total_bookings"),
        F.max("requested_date").alias("last_booking_date")], as_of, days)


def contact_rows(rows: DataFrame, facts: list[Column], as_of, days: list[int]) -> DataFrame:
    """The rows of ``marketing_master``; ``facts`` fold a customer's rows."""
    today = F.current_date().cast("timestamp_ntz") if as_of is None else moment(as_of)
    grouped = rows.groupBy("phone").agg(*facts)
    idle = whole_days_between(F.col("last_booking_date"), today)
    return grouped.select("*", *[holds(idle > d).alias(f"no_booking_in_last_{d}_days") for d in days])


def leads_without_bookings(leads: DataFrame, bookings: DataFrame, number: str = "number",
                           heavy_rows: int | None = None) -> DataFrame:
    """Distinct leads whose number has no booking that was not cancelled.

    A missing number counts as booked when some booking has no phone.
    """
    booked = bookings.where(differs(F.col("status"), "cancelled")).select(F.col("phone").alias("_phone")).distinct()
    # The missing numbers are settled by one yes/no, so they never have to meet in one task.
    unnamed = booked.where(F.col("_phone").isNull())
    known = booked.where(F.col("_phone").isNotNull()).select(
        F.col("_phone").alias(number), F.lit(True).alias("_booked"))
    counted = known.join(skew.key_counts(leads, number), number, "left").select(
        number, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "_booked")
    spread = F.struct(*leads.columns)
    marked = skew.attach(leads.dropDuplicates(), counted, number, spread, floor=heavy_rows)
    no_phone = unnamed.agg(F.count(F.lit(1)).alias("n")).scalar() > 0
    taken = F.when(F.col(number).isNull(), no_phone).otherwise(F.coalesce("_booked", F.lit(False)))
    return marked.where(~taken).select(*leads.columns)
