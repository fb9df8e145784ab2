"""The operators' input tables derived from the star-schema test tables.

All mappings are narrow: every column is an expression over one row of the
source table, so a report's plan shows the report's own shuffles only. Money is
in multiples of 1/8, which makes every sum exact whatever the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import LOGISTICS_REASONS, QUALITY_REASONS, SERVICE_REASONS

_S1, _S2 = SERVICE_REASONS
_Q1, _Q2 = QUALITY_REASONS
_L1, _L2 = LOGISTICS_REASONS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: Column, values: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def _slot_text(key: Column) -> Column:
    opens = F.lit(8) + F.lit(2) * (key % 6)
    return F.concat(opens.cast("string"), F.lit("-"), (opens + 2).cast("string"))


def bookings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    amount = F.when(k % 37 == 0, F.lit(0.0)).otherwise(F.floor(F.col("o_totalprice") / 1000).cast("double"))
    mixed = F.when(k % 3 == 0, "Laundry").when(k % 3 == 1, "Regular Laundry").otherwise("Household")
    category = (
        F.when(c % 5 == 0, "Laundry").when(c % 5 == 1, "Regular Laundry")
        .when(c % 5 == 2, F.when(k % 10 == 0, "Regular Laundry").otherwise("Laundry"))
        .when(k % 43 == 0, F.lit(None).cast("string")).otherwise(mixed))
    status = (
        F.when(k % 89 == 0, F.lit(None).cast("string"))
        .when(F.col("o_orderstatus") == "P", "cancelled")
        .when(F.col("o_orderstatus") == "F", F.when(k % 2 == 0, "service_complete").otherwise("closed"))
        .otherwise(F.when(k % 5 == 0, "payment_pending").otherwise("in_service")))
    cancelled = status == "cancelled"
    return o.select(
        k.alias("booking_id"),
        F.when(k % 13 == 0, k).when(k % 11 == 0, k - 11).alias("parent_id"),
        F.when(k % 101 != 0, c).alias("phone"),
        F.when(k % 5 != 0, F.concat(F.lit("Name "), c.cast("string"), F.lit("-"), (k % 3).cast("string"))
               ).alias("customer_name"),
        F.when(k % 4 != 0, F.concat(F.lit("c"), c.cast("string"), F.lit("@example.com"))).alias("email"),
        F.concat(F.lit("NATION_"), (c % 25).cast("string")).alias("city"),
        F.when(k % 53 != 0, F.concat(F.lit("loc_"), (c % 200).cast("string"))).alias("locality"),
        category.alias("category"),
        F.when(c % 10 == 0, "Dry Cleaning").when(k % 97 == 0, F.lit(None).cast("string"))
        .when(k % 2 == 0, "Dry Cleaning").otherwise("Wash and Iron").alias("type"),
        status.alias("status"),
        F.col("o_orderdate").alias("requested_date"),
        _slot_text(k).alias("requested_time"),
        amount.alias("amount"),
        F.when(k % 17 != 0, amount * 0.125).alias("taxes"),
        F.when(k % 6 != 0, amount * 0.25 * (k % 4)).alias("discount_amount"),
        F.when(k % 9 == 0, F.lit(None).cast("double")).when(k % 7 == 0, F.lit(-16.0))
        .otherwise((k % 5).cast("double") * 8.0).alias("credits_used"),
        F.when(k % 19 != 0, (k % 50).cast("double") * 4.0).alias("customer_credits"),
        F.when(k % 3 == 0, F.concat(F.lit("CPN"), (k % 10).cast("string"))).alias("coupon"),
        F.when(k % 4 == 0, 1).otherwise(0).alias("referred"),
        F.when(k % 26 == 0, F.lit("Rescheduled")).alias("rescheduled_redo"),
        F.when(k % 7 != 0, F.substring("o_orderpriority", 1, 1).cast("double")).alias("feedback"),
        F.when(k % 29 != 0, (c % 6).cast("double")).alias("rating"),
        _pick(k % 8, {1: _S1, 3: f"{_S1},{_Q2}", 5: f"{_L1},{_L2},{_Q1}", 6: _S2}).alias("bad_rating_reason"),
        F.when(cancelled & (k % 31 != 0), _pick(k % 6, {
            0: "customer_cancellation", 1: "reschedule_by_customer", 2: "stock_out",
            3: "out_of_geographical_area", 4: "reschedule_stock_out", 5: "wrong_booking"})).alias("cancel_reason"),
        F.when(cancelled & (k % 7 != 0), F.concat(F.lit("reason_"), (k % 3).cast("string"))
               ).alias("booking_cancel_reason"),
        F.when(k % 23 != 0, (k % 4).cast("double")).alias("cancelled_pickup_visits"),
        F.when(k % 71 != 0, F.concat(F.when(k % 2 == 0, "  SP ").otherwise("sp "), (c % 60).cast("string"), F.lit(" "))
               ).alias("pickup_by"),
        F.concat(F.when(k % 3 == 0, " Sp ").otherwise("SP "), (c % 45).cast("string")).alias("delivery_by"),
        F.when(k % 12 != 0, F.col("o_orderdate") + F.make_dt_interval(
            (k % 5 + 1).cast("int"), (k % 10).cast("int"))).alias("delivery_scheduled_time"),
    )


def booking_dumps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping dumps of the same bookings, each with gaps the other can fill."""
    b = bookings(spark, sf_dir)
    k = F.col("booking_id")
    newer = b.where(k % 3 != 0).withColumns({
        "status": F.when(k % 4 != 1, F.col("status")),
        "feedback": F.when(k % 5 != 2, F.col("feedback")),
    })
    older = b.where(k % 3 != 1).withColumns({
        "status": F.when(k % 7 == 0, F.lit("in_service")).otherwise(F.col("status")),
        "amount": F.col("amount") + 8.0,
    })
    return newer, older.withColumn("old_only", F.lit(1))


def more_dumps(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The two dumps and a third, oldest one with fewer columns, newest first."""
    k = F.col("booking_id")
    oldest = bookings(spark, sf_dir).where(k % 5 < 3).withColumns({
        "status": F.lit("closed"), "feedback": F.coalesce("feedback", F.lit(2.0)), "taxes": F.coalesce("taxes", F.lit(4.0)),
    }).drop("email", "locality")
    return [*booking_dumps(spark, sf_dir), oldest]


def _visit_base() -> Column:
    """Day a booking was asked for, the same on all of its visits."""
    return F.date_add(F.lit("1995-01-01").cast("date"), (F.col("l_orderkey") % 2400).cast("int")).cast("timestamp_ntz")


def _half_hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), (n * 30).cast("int"))


def pickup_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    k, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    slot = _visit_base() + F.make_dt_interval(F.lit(0), (F.lit(8) + F.lit(2) * (k % 6)).cast("int"))
    return li.select(
        k.alias("booking_id"),
        F.concat(F.lit("NATION_"), (k % 25).cast("string")).alias("city"),
        _visit_base().alias("requested_date"),
        _slot_text(k).alias("requested_time"),
        F.col("l_shipdate").alias("scheduled_time"),
        F.when(p % 17 != 0, slot + _half_hours((p + s) % 14 - 4)).alias("updation_time"),
        F.when(p % 19 != 0, slot + _half_hours(p % 9 - 4)).alias("creation_time"),
        F.when(p % 23 != 0, slot + _half_hours(s % 11 - 3)).alias("cancellation_time"),
        F.when(p % 13 != 0, _pick(p % 8, {
            0: "Not available at the address - called twice", 1: "Outside geographical limits",
            2: "NOT able to locate the given address", 3: "not opening the door now",
            4: "Bad weather today", 5: "Others ", 6: "Vehicle broke down", 7: "No cash"})
               ).alias("visit_cancel_reason"),
        F.when(F.col("l_returnflag") == "A", "done").when(F.col("l_returnflag") == "R", "cancelled")
        .when(F.col("l_linestatus") == "F", "cancelled").otherwise("scheduled").alias("visit_status"),
    )


def delivery_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    k, p, s, n = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    base = _visit_base()

    def stamp(i):
        return F.date_format(base + F.make_dt_interval(F.lit(i), (k % 10).cast("int")), "yyyy-MM-dd HH:mm:ss")

    return li.select(
        (n.cast("bigint") * 100_000_000_000_000 + p * 10_000_000 + s).alias("visit_id"),
        k.alias("booking_id"),
        F.concat(F.lit("NATION_"), (k % 25).cast("string")).alias("city"),
        F.concat(F.lit("loc_"), (k % 200).cast("string")).alias("locality"),
        F.when(k % 10 != 0, F.date_format(base + F.make_dt_interval(F.lit(2)), "yyyy-MM-dd")).alias("requested_date"),
        F.when(k % 16 != 0, _slot_text(k)).alias("requested_time"),
        F.col("l_shipdate").alias("scheduled_time"),
        F.when(p % 17 != 0, base + F.make_dt_interval(F.lit(2), (p % 24).cast("int"))).alias("updation_time"),
        (base + F.make_dt_interval((n - 1).cast("int"), (p % 24).cast("int"))).alias("creation_time"),
        F.when(s % 9 != 0, base + F.make_dt_interval((n % 4).cast("int"), (p % 24).cast("int"), (s % 60).cast("int"))
               ).alias("cancellation_time"),
        F.when(p % 13 != 0, _pick(p % 7, {
            0: "Not available at given address", 1: "not able to locate the address yet",
            2: "Not opening the door at all", 3: "Cash not available today",
            4: "Traffic problem on the way", 5: "DB refused", 6: "Other"})).alias("visit_cancel_reason"),
        F.when(F.col("l_returnflag") == "A", "done").when(F.col("l_returnflag") == "R", "cancelled")
        .when(F.col("l_linestatus") == "F", "cancelled").otherwise("scheduled").alias("visit_status"),
        F.when(k % 4 == 1, stamp(1)).when(k % 4 == 2, F.concat_ws(",", stamp(1), stamp(2)))
        .when(k % 4 == 3, F.concat_ws(",", stamp(0), stamp(1), stamp(3))).alias("ofd_happened_at"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind, i = F.col("event_type"), F.col("event_id")
    inbound = kind.isin("error", "view") | ((kind == "signup") & (i % 6 == 0))
    customer, desk = F.col("user_id").cast("string"), F.concat(F.lit("D"), (i % 12).cast("string"))
    return e.select(
        i.alias("call_id"),
        F.when(inbound, "inbound").when(kind == "click", "outbound-dial").otherwise("outbound-api").alias("direction"),
        F.when(inbound, customer).otherwise(desk).alias("from_number"),
        F.when(inbound, F.lit("desk")).otherwise(customer).alias("to_number"),
        F.when(kind == "error", "missed-call").when(kind.isin("view", "click"), "completed")
        .when(kind == "purchase", "no-answer").when(inbound, "busy").otherwise("missed-call").alias("status"),
        F.col("ts").alias("start_time"),
        F.when(i % 41 != 0, F.col("value")).alias("billable_duration"),
    )


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call-centre numbers, each listed by many suppliers."""
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("D"), (F.col("s_suppkey") % 9).cast("string")).alias("number"))


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaigns of the suppliers: overlapping stretches of up to forty days, in the order of their numbers; some never begin."""
    k = F.col("s_suppkey").cast("int")
    start = F.date_add(F.lit("1995-01-01").cast("date"), (k * 37) % 2400)
    return table(spark, sf_dir, "supplier").select(
        (k % 50).alias("ord"), F.concat(F.lit("C"), (k % 500).cast("string")).alias("label"),
        F.when(k % 29 != 0, start).alias("start"), F.date_add(start, k % 41 - 1).alias("end"))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind, i, v = F.col("event_type"), F.col("event_id"), F.col("value")
    l2 = (
        F.when(kind == "click", "pickup").when(kind == "error", "delivery").when(kind == "view", "Quality")
        .when(kind == "purchase", F.when(i % 2 == 0, "Refund").otherwise("Clothes Lost/Exchanged"))
        .otherwise(F.when(i % 3 == 0, "Dry cleaning").when(i % 3 == 1, "Wash and iron prime")
                   .otherwise("Wash and iron by weight")))
    l1 = (
        F.when(kind == "click", "Pickup").when(kind == "error", "Delivery")
        .when(kind == "signup", "Wash quality").otherwise("Other"))
    l3 = F.when(i % 37 == 0, F.lit(None).cast("string")).when(kind == "view", _pick(i % 6, {
        0: "Bad packaging", 1: "Shrinkage", 2: "Wet clothes/Bad smell", 3: "others",
        4: "Clothes not cleaned properly/Stain not removed",
        5: "Ironing issue-Poor finishing/iron marks/Lint"})).otherwise(_pick(i % 6, {
            0: "Request for change in pick up time slot : early, late, reschedule",
            1: "Pick up pending and was not done in the requested time slot",
            2: "Customer not available in the requested time slot",
            3: "Request for change in delivery time slot : early, late, reschedule",
            4: "cancel booking", 5: "Others"}))
    return e.select(
        i.alias("issue_id"), i.alias("booking_id"),
        F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string")).alias("city"),
        _pick(i % 4, {0: "Dry Cleaning and Special Care", 1: "Wash and Fold by weight",
                      2: "Wash and Iron Prime", 3: "Household"}).alias("category"),
        l1.alias("l1_subtype"), l2.alias("l2_subtype"), l3.alias("l3_subtype"),
        F.when(i % 8 != 0, F.when(i % 2 == 0, "desk").otherwise("internal")).alias("source"),
        _pick(i % 5, {0: "Mumbai Delivery ( After RFD )", 1: "Mumbai Logistics (pickup)",
                      2: "Bangalore logistics (pickup)", 3: "CC_customers"}).alias("owner"),
        F.concat(F.lit("agent_"), (i % 9).cast("string")).alias("closed_by"),
        F.col("ts").alias("created_at"),
        (F.date_trunc("second", F.col("ts")).cast("timestamp_ntz") + F.make_dt_interval(
            F.lit(0), F.lit(0), F.lit(0), F.floor(v * 600))).alias("closed_at"),
        (i % 10 == 0).alias("active"),
        F.when(i % 31 == 0, "n/a").otherwise((v * 4).cast("string")).alias("first_response_min"),
        F.when(i % 43 == 0, "n/a").otherwise(v.cast("string")).alias("hours_to_close"),
    )


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as leads: some twice, some with a number nobody booked with, some without number."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    number = F.when(k % 50 == 7, F.lit(None).cast("bigint")).when(k % 3 == 0, k + 100_000_000).otherwise(k)
    row = c.select(number.alias("number"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), k)
    return row.withColumn("_copy", F.explode(F.when(k % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(1))))).select("number", "name", "segment")
