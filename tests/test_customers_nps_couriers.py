import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from opslens.functions.columns import nps_score
from opslens.operators import cohorts as K
from opslens.operators import couriers as R
from opslens.operators import customers as U
from opslens.operators import nps as N
from opslens.sources import adapters as A
from tests.helpers import by, frame, ts

SF = "/root/testdata/sf0.001"
CORE = """booking_id bigint, phone bigint, status string, requested_date timestamp_ntz, booking_month string,
successful_bookings bigint, only_dc int, total_revenue double"""


def core_row(i, phone, day, n, revenue, dc=None):
    return dict(booking_id=i, phone=phone, status="closed", requested_date=ts(day), booking_month=day[:7],
                successful_bookings=n, only_dc=dc, total_revenue=float(revenue))


def test_core_customers_and_the_dry_cleaning_switch(spark):
    df = frame(spark, CORE, [
        core_row(1, 1, "2016-01-02", 2, 10), core_row(2, 1, "2016-01-20", 2, 20),   # 30 days / 2 = 15: core
        core_row(3, 2, "2016-01-20", 1, 40),                                        # one booking: not core
        core_row(4, 3, "2016-01-01", 2, 80, 1), core_row(5, 3, "2016-01-02", 2, 5, 1),  # dry cleaning, 15 days
        core_row(6, 4, "2015-11-01", 2, 7), core_row(7, 4, "2016-02-09", 2, 9),     # not in the month
        core_row(8, None, "2016-01-02", 2, 999),
    ])
    fixed = U.core_customers(df, [("2016-02-01", "2016-01")]).first()
    assert (fixed.users, fixed.gmv) == (3, 155.0)
    assert fixed.core_share == pytest.approx(2 / 3) and fixed.core_gmv_share == pytest.approx(115 / 155)
    reported = U.core_customers(df, [("2016-02-01", "2016-01")], fix_dc=False).first()
    assert reported.core_share == pytest.approx(1 / 3) and reported.core_gmv_share == pytest.approx(30 / 155)


def test_profile_buckets_equal_pandas_qcut(spark):
    out = U.customer_profile(A.bookings(spark, SF), "2002-01-01").toPandas()
    for m in U.PROFILE_METRICS:
        codes = pd.qcut(out[m], 5, labels=False) + 1
        assert (out[f"{m}_bucket"] == codes).all()
        edges = np.quantile(out[m], np.linspace(0, 1, 6))
        assert sorted(set(out[f"{m}_lo"])) == pytest.approx(sorted(edges[:-1]))
        assert sorted(set(out[f"{m}_hi"])) == pytest.approx(sorted(edges[1:]))


def test_profile_ties_share_a_bucket(spark):
    ddl = "phone bigint, status string, requested_date timestamp_ntz, amount double, discount_amount double, credits_used double"
    rows = [dict(phone=i, status="closed", requested_date=ts("2016-01-01"), amount=10.0 if i < 8 else 50.0 + i) for i in range(10)]
    got = by(U.customer_profile(frame(spark, ddl, rows), "2016-02-01"), "phone")
    assert len({got[i]["avg_paid_bucket"] for i in range(8)}) == 1
    assert got[9]["avg_paid_bucket"] == 5


def test_marketing_flags_use_whole_days(spark):
    ddl = """booking_id bigint, phone bigint, customer_name string, email string, locality string, city string, rating double,
    customer_credits double, customer_segment string, feedback double, requested_date timestamp_ntz"""
    rows = [dict(booking_id=2, phone=1, customer_name="b", city="M", requested_date=ts("2016-01-01 12:00:00"), feedback=4.0),
            dict(booking_id=1, phone=1, email="e", city="M", requested_date=ts("2015-12-01")),
            dict(booking_id=3, phone=2, city="D", requested_date=ts("2016-01-01"))]
    r = U.marketing_master(frame(spark, ddl, rows), "M", "2016-02-01").collect()
    assert len(r) == 1
    assert (r[0].customer_name, r[0].email, r[0].total_bookings, r[0].avg_feedback) == ("b", "e", 2, 4.0)
    assert (r[0].no_booking_in_last_30_days, r[0].no_booking_in_last_45_days) == (False, False)


@pytest.mark.parametrize("heavy", [0, 10**6])
def test_leads(spark, heavy):
    leads = frame(spark, "number bigint, name string", [
        {"number": 1, "name": "a"}, {"number": 2, "name": "b"}, {"number": 2, "name": "b"}, {"number": 3, "name": "c"},
        {"name": "none"}, {"number": 4, "name": "d"}, {"number": 2, "name": "other"}])
    bookings = [{"phone": 1, "status": "closed"}, {"phone": 2, "status": "cancelled"}, {"phone": 4}]
    ddl = "phone bigint, status string"
    got = U.leads_without_bookings(leads, frame(spark, ddl, bookings), heavy_rows=heavy)
    assert sorted(got.collect(), key=str) == sorted([(2, "b"), (2, "other"), (3, "c"), (None, "none")], key=str)
    got = U.leads_without_bookings(leads, frame(spark, ddl, bookings + [{"status": "closed"}]), heavy_rows=heavy)
    assert (None, "none") not in {tuple(r) for r in got.collect()}


def test_courier_sides_and_days(spark):
    ddl = """booking_id bigint, status string, requested_date timestamp_ntz, pickup_by string, delivery_by string,
    delivery_scheduled_time timestamp_ntz"""
    df = frame(spark, ddl, [
        dict(booking_id=1, status="closed", requested_date=ts("2016-07-03"), pickup_by=" Ann ", delivery_by="ann",
             delivery_scheduled_time=ts("2016-07-03 18:00:00")),
        dict(booking_id=2, status="closed", requested_date=ts("2016-07-03"), pickup_by="ANN", delivery_by="Bo",
             delivery_scheduled_time=ts("2016-08-01")),
        dict(booking_id=3, status="cancelled", requested_date=ts("2016-07-03"), pickup_by="ann"),
        dict(booking_id=4, status="in_service", requested_date=ts("2016-07-04"), delivery_by="Bo",
             delivery_scheduled_time=ts("2016-07-05"))])
    got = by(R.courier_productivity(df, "2016-07"), "sp", "date")
    assert {k: (v["pickups"], v["deliveries"]) for k, v in got.items()} == {("ann", "03"): (2, 1), ("bo", "05"): (None, 1)}
    extract = by(R.courier_extract(df, "2016-07", ["ann", "bo"], ["ann"]), "role", "courier", "booking_id")
    assert set(extract) == {("delivery", "ann", 1), ("pickup", "ann", 1), ("pickup", "ann", 2), ("delivery", "bo", 4)}


NPS = "booking_id bigint, week string, city string, status string, locality string, feedback double, bad_rating_reason string"


def scored(spark, rows):
    return frame(spark, NPS, rows).withColumn("nps", nps_score(F.col("feedback")))


def test_nps_sizes_counts_and_thresholds(spark):
    df = scored(spark, [dict(booking_id=1, week="a", feedback=5.0, status="closed"), dict(booking_id=2, week="a", status="closed"),
                        dict(booking_id=3, week="b", feedback=1.0, status="closed"), dict(booking_id=4, feedback=1.0)])
    got = by(N.nps_summary(df, ["week"]), "week")
    assert {k: (v["size"], v["count"], v["mean"]) for k, v in got.items()} == {"a": (2, 1, 1.0), "b": (1, 1, -1.0)}
    assert [r.week for r in N.nps_summary(df, ["week"], ["closed"], 1, 0.1).collect()] == ["a"]


def test_reason_shares_count_all_feedback_of_the_period(spark):
    df = scored(spark, [dict(booking_id=1, week="a", feedback=1.0, bad_rating_reason="x,y"), dict(booking_id=2, week="a", feedback=5.0),
                        dict(booking_id=3, week="a", bad_rating_reason="x"), dict(booking_id=4, week="a", feedback=3.0, bad_rating_reason="x, z")])
    got = by(N.reason_share(df, "week"), "reason")
    assert {k: (v["mentions"], v["feedbacks"]) for k, v in got.items()} == {"x": (3, 3), "y": (1, 3), " z": (1, 3)}
    pct = by(N.reason_pct(df, ["x", "y"]), "nps_split", "reason")
    assert {k: v["pct"] for k, v in pct.items()} == {("-ve", "x"): 25.0, ("-ve", "y"): 25.0, ("+ve", "x"): 50.0}
    counts = by(N.reason_counts(df), "reason", "feedback")
    assert {k: v["mentions"] for k, v in counts.items()} == {("x", 1.0): 1, ("y", 1.0): 1, ("x", 3.0): 1, (" z", 3.0): 1}


def test_weekly_nps_needs_both_ends(spark):
    df = scored(spark, [dict(booking_id=1, week="a", feedback=5.0), dict(booking_id=2, week="a", feedback=1.0),
                        dict(booking_id=3, week="a"), dict(booking_id=4, week="a", feedback=5.0), dict(booking_id=5, week="b", feedback=5.0)])
    got = by(N.nps_weekly(df), "week")
    assert got["a"]["nps"] == pytest.approx(1 / 3) and got["a"]["response_pct"] == 75
    assert (got["b"]["promoters"], got["b"]["detractors"], got["b"]["nps"]) == (1.0, None, None)
    assert all(-1 <= r.mean <= 1 for r in N.nps_summary(df, ["week"]).collect())


@pytest.mark.parametrize("heavy", [0, 10**6])
def test_good_locality_cohorts_ignore_other_localities(spark, heavy):
    b = A.bookings(spark, SF)
    good = N.good_localities(b.withColumn("nps", nps_score(F.col("feedback"))), 5, 0.1, ["closed", "service_complete"])
    named = [r.locality for r in good.collect()]
    total = by(K.cohorts_for_good_localities(b, excluded_month=None, heavy_rows=heavy).where("variant = 'Overall'")
               .groupBy().agg(F.sum("bookings").alias("n"), F.lit(1).alias("k")), "k")[1]["n"]
    kept = b.where(F.col("locality").isin(named) & F.col("status").isin("closed", "service_complete", "in_service") & F.col("phone").isNotNull())
    assert total == kept.count()
