"""Explicit schemas of the input tables.

``*_FILE`` schemas describe exported text files, in which dates and lenient
numbers are still text; ``readers`` turns them into the typed tables.
"""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(),
    "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType(),
}


def _schema(ddl: str) -> T.StructType:
    fields = [entry.split() for entry in ddl.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


BOOKINGS = _schema("""
    booking_id bigint, parent_id bigint, phone bigint, customer_name string, email string,
    city string, locality string, category string, type string, status string,
    requested_date timestamp_ntz, requested_time string, amount double, taxes double,
    discount_amount double, credits_used double, customer_credits double, coupon string,
    referred int, rescheduled_redo string, feedback double, rating double, bad_rating_reason string,
    cancel_reason string, booking_cancel_reason string, cancelled_pickup_visits double,
    pickup_by string, delivery_by string, delivery_scheduled_time timestamp_ntz,
    rfd_time string, paid_online double, paid_cash double, invoice_date string, tags string,
    hub string, facility string, lead_channel string, tat double
""")

PICKUP_VISITS = _schema("""
    booking_id bigint, city string, requested_date timestamp_ntz, requested_time string,
    scheduled_time timestamp_ntz, updation_time timestamp_ntz, creation_time timestamp_ntz,
    cancellation_time timestamp_ntz, visit_cancel_reason string, visit_status string
""")

DELIVERY_VISITS = _schema("""
    visit_id bigint, booking_id bigint, city string, locality string, requested_date string,
    requested_time string, scheduled_time timestamp_ntz, updation_time timestamp_ntz,
    creation_time timestamp_ntz, cancellation_time timestamp_ntz, visit_cancel_reason string,
    visit_status string, ofd_happened_at string
""")

CALLS = _schema("""
    call_id bigint, direction string, from_number string, to_number string, status string,
    start_time timestamp_ntz, billable_duration double
""")

AGENTS = _schema("number string")

ISSUES = _schema("""
    issue_id bigint, booking_id bigint, city string, category string, l1_subtype string,
    l2_subtype string, l3_subtype string, source string, owner string, closed_by string,
    created_at timestamp_ntz, closed_at timestamp_ntz, active boolean,
    first_response_min string, hours_to_close string
""")

LEADS = _schema("number bigint")

TABLES = {
    "bookings": BOOKINGS,
    "pickup_visits": PICKUP_VISITS,
    "delivery_visits": DELIVERY_VISITS,
    "calls": CALLS,
    "agents": AGENTS,
    "issues": ISSUES,
    "leads": LEADS,
}
