import random

import pytest
from pyspark.sql import functions as F

from opslens.operators import bookings as B
from opslens.operators import cohorts as K
from opslens.operators import skew
from opslens.sources import adapters as A
from tests.helpers import by, frame, ts

SF = "/root/testdata/sf0.001"
DDL = """booking_id bigint, parent_id bigint, phone bigint, category string, type string, status string,
requested_date timestamp_ntz, amount double, taxes double, discount_amount double, credits_used double,
customer_credits double, coupon string, referred int, rescheduled_redo string, feedback double"""


def booking(i, phone, day, **more):
    return {"booking_id": i, "phone": phone, "requested_date": ts(day), "status": "closed", "category": "Laundry",
            "type": "Dry Cleaning", "amount": 100.0, **more}


def test_merge_prefers_newer_cells_and_fills_gaps(spark):
    newer = frame(spark, "booking_id bigint, a string, b string", [
        {"booking_id": 1, "a": "new"}, {"booking_id": 2, "a": "n2", "b": "n2"}])
    older = frame(spark, "booking_id bigint, b string, a string, extra int", [
        {"booking_id": 1, "a": "old", "b": "old"}, {"booking_id": 3, "a": "o3", "extra": 1}])
    out = B.merge_bookings(newer, older)
    assert out.columns == ["booking_id", "a", "b"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "new", "old"), (2, "n2", "n2"), (3, "o3", None)]


def test_revenue_clamps_credits_and_fills_gaps(spark):
    df = frame(spark, DDL, [booking(1, 1, "2016-01-05", credits_used=-5.0), booking(
        2, 1, "2016-02-05", taxes=10.0, discount_amount=20.0, credits_used=5.0)])
    got = by(B.with_revenue(df).withColumn("paid", B.actual_paid()), "booking_id")
    assert (got[1]["total_revenue"], got[1]["amp"], got[1]["paid"], got[1]["booking_month"]) == (100, 100, 100, "2016-01")
    assert (got[2]["total_revenue"], got[2]["amp"], got[2]["paid"]) == (110, 85, 75)


def enriched(spark, rows, **options):
    return by(B.enrich_customers(B.with_revenue(frame(spark, DDL, rows)), **options), "booking_id")


def test_first_booking_decides_source_and_cohort(spark):
    got = enriched(spark, [
        booking(5, 1, "2016-02-01", coupon="C", referred=0),
        booking(7, 1, "2016-02-01", referred=1),
        booking(3, 1, "2016-03-01", referred=1, coupon="C"),
        booking(9, None, "2016-01-01"),
        booking(10, 1, "2015-01-01", status="cancelled"),
    ])
    assert set(got) == {3, 5, 7}
    assert {r["acquisition_source"] for r in got.values()} == {"Only Marketing"}
    assert {r["cohort_group"] for r in got.values()} == {"2016-02"}
    assert [got[i]["booking_count"] for i in (5, 7, 3)] == [1, 2, 3]
    assert [got[i]["new_repeat"] for i in (5, 7, 3)] == ["first_booking", "repeat_booking", "repeat_booking"]


def test_dump_order_numbers_by_id(spark):
    got = enriched(spark, [booking(5, 1, "2016-02-01"), booking(3, 1, "2016-03-01")], order_by=("booking_id",))
    assert (got[3]["booking_count"], got[5]["booking_count"]) == (1, 2)


def test_latest_credits_take_the_first_of_equal_dates(spark):
    got = enriched(spark, [
        booking(1, 1, "2016-01-01", customer_credits=1.0), booking(2, 1, "2016-03-01", customer_credits=2.0),
        booking(3, 1, "2016-03-01", customer_credits=3.0)])
    assert {r["customer_credits"] for r in got.values()} == {2.0}


@pytest.mark.parametrize("rows,segment,only_dc", [
    ([("Laundry", "Dry", 10)], "only premium", 1),
    ([("Laundry", None, 10)], "only premium", 1),
    ([("Laundry", "Wash", 10)], "only premium", None),
    ([("Regular Laundry", "Wash", 10)], "only regular", None),
    ([("Laundry", "Wash", 5), ("Regular Laundry", "Wash", 95)], "only regular", None),
    ([("Laundry", "Wash", 95), ("Regular Laundry", "Wash", 5)], "only premium", None),
    ([("Laundry", "Wash", 10), ("Regular Laundry", "Wash", 90)], "both premium & regular", None),
    ([("Laundry", "Dry", 50), (None, "Dry", 500)], "only premium", None),
    ([("Other", "Dry", 0)], "both premium & regular", None),
])
def test_segments(spark, rows, segment, only_dc):
    df = frame(spark, DDL, [booking(i, 1, "2016-01-01", category=c, type=t, amount=float(a))
                            for i, (c, t, a) in enumerate(rows)])
    r = B.customer_segment(df).first()
    assert (r.customer_segment, r.only_dc) == (segment, only_dc)


@pytest.mark.parametrize("paid,bookings,rating", [
    (2.0, 1, 1.0), (54.0, 2, 2.0), (149.0, 3, 3.0), (249.0, 4, 4.0), (250.0, 6, 5.0), (1.0, 6, 3.0)])
def test_ratings(spark, paid, bookings, rating):
    df = frame(spark, DDL, [booking(i, 1, "2016-01-01", amount=paid) for i in range(bookings)])
    assert B.customer_rating(B.with_revenue(df)).first().rating == rating


def test_duplicates_need_the_same_phone_and_no_redo(spark):
    got = enriched(spark, [
        booking(1, 1, "2016-01-01"), booking(2, 1, "2016-01-02", parent_id=1), booking(3, 2, "2016-01-02", parent_id=1),
        booking(4, 1, "2016-01-03", parent_id=1, rescheduled_redo="Redo"), booking(5, 1, "2016-01-04", parent_id=99)])
    assert [got[i]["duplicate_booking"] for i in (1, 2, 3, 4, 5)] == [None, 1, None, None, None]


@pytest.mark.parametrize("order_by", [("requested_date", "booking_id"), ("booking_id",)])
def test_sliced_customers_get_the_same_result(spark, order_by):
    priced = B.with_revenue(A.bookings(spark, SF)).withColumn(
        "phone", F.when(F.col("booking_id") % 3 == 0, F.lit(7)).otherwise(F.col("phone")))
    plain = B.enrich_customers(priced, order_by=order_by)
    sliced = B.enrich_customers(priced, order_by=order_by, heavy_rows=5, slice_ids=40)
    assert sliced.count() == plain.count()
    assert plain.exceptAll(sliced).count() == 0


def test_attach_gives_heavy_light_and_missing_keys_their_row(spark):
    rng = random.Random(1)
    rows = [(i, None if i % 10 == 0 else (1 if i % 3 == 0 else rng.randrange(2, 30))) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, k bigint")
    stats = skew.key_counts(df, "k").where("k <> 5").withColumn("twice", F.col("k") * 2)
    got = {r.id: r.twice for r in skew.attach(df, stats, "k", F.col("id"), floor=30).collect()}
    assert got == {i: None if k is None or k == 5 else 2 * k for i, k in rows}


def test_cohort_first_month_share_is_one(spark):
    m = K.cohort_matrix(B.enrich_customers(B.with_revenue(A.bookings(spark, SF))))
    assert m.where("cohort_group = booking_month").where(
        "users_share <> 1 or bookings_share <> 1").count() == 0


def test_cohort_variants_follow_their_conditions(spark):
    rows = [
        dict(booking_id=1, phone=1, cohort_group="2016-01", booking_month="2016-01", successful_bookings=1, amp=0.0,
             rating=4.0, feedback=5.0, total_revenue=10.0, city="A"),
        dict(booking_id=2, phone=2, cohort_group="2016-01", booking_month="2016-01", successful_bookings=2, amp=0.0,
             rating=2.0, feedback=1.0, total_revenue=20.0, city="A"),
        dict(booking_id=3, phone=2, cohort_group="2016-01", booking_month="2016-02", successful_bookings=2, amp=9.0,
             rating=2.0, total_revenue=5.0, city="A"),
        dict(booking_id=4, phone=3, cohort_group="2015-04", booking_month="2016-02", successful_bookings=2, amp=9.0,
             rating=5.0, total_revenue=5.0, city="A"),
        dict(booking_id=5, phone=4, cohort_group="2016-01", booking_month="2016-02", successful_bookings=2, amp=9.0,
             rating=5.0, total_revenue=5.0, city="B"),
    ]
    ddl = """booking_id bigint, phone bigint, cohort_group string, booking_month string, successful_bookings bigint,
    amp double, rating double, feedback double, total_revenue double, city string"""
    got = by(K.cohort_variants(frame(spark, ddl, rows), city="A"), "variant", "booking_month")
    assert {k: v["bookings"] for k, v in got.items()} == {
        ("Overall", "2016-01"): 2, ("Overall", "2016-02"): 1, ("wo_garbage", "2016-01"): 1, ("wo_garbage", "2016-02"): 1,
        ("atleast_2_bookings", "2016-01"): 1, ("atleast_2_bookings", "2016-02"): 1,
        ("avg_feedback>=3", "2016-01"): 1, ("profile=4,5", "2016-01"): 1}
    assert got[("Overall", "2016-02")]["revenue_share"] == pytest.approx(5 / 30)


def test_a_booking_listed_twice_does_not_multiply_its_children(spark):
    rows = frame(spark, DDL, [booking(1, 5, "2016-01-01"), booking(1, 5, "2016-01-01"), booking(2, 5, "2016-01-02", parent_id=1)])
    got = B.duplicate_flag(rows).collect()
    assert sorted((r.booking_id, r.duplicate_booking) for r in got if r.booking_id == 2) == [(2, 1)] and len(got) == 3


def test_a_customer_with_a_third_of_the_rows_is_spread(spark):
    rows = [{"booking_id": i, "phone": 1 if i % 3 == 0 else i, "status": "closed", "amount": 8.0,
             "requested_date": None if i % 50 == 0 else ts(f"2016-08-{1 + i % 4:02d}")} for i in range(1, 1200)]
    df = B.with_revenue(frame(spark, DDL, rows))
    got = {r.booking_id: r.booking_count for r in B.enrich_customers(df).where("phone = 1").collect()}
    ordered = sorted((r for r in rows if r["phone"] == 1), key=lambda r: (
        r["requested_date"] is None, r["requested_date"] or ts("2016-01-01"), r["booking_id"]))
    assert got == {r["booking_id"]: i + 1 for i, r in enumerate(ordered)}
    cut = skew.cut(df, "phone", [F.col("requested_date").isNull(), F.col("requested_date"), F.col("booking_id")], "_slice")
    sizes = [r["count"] for r in cut.where("phone = 1").groupBy("_slice").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 300


def test_any_number_of_dumps_fold_to_the_newest_cells(spark):
    ddl = "booking_id bigint, status string, amount double"
    a = frame(spark, ddl, [{"booking_id": 1, "status": None, "amount": 1.0}, {"booking_id": None, "status": "x"}])
    b = frame(spark, ddl + ", other int", [{"booking_id": 1, "status": "b", "amount": 9.0}, {"booking_id": 2, "status": None}])
    c = frame(spark, "status string, booking_id bigint", [{"booking_id": 2, "status": "c"}, {"booking_id": None, "status": "y"}])
    got = sorted(((r.booking_id, r.status, r.amount) for r in B.merge_dumps([a, b, c]).collect()), key=str)
    assert got == sorted([(1, "b", 1.0), (2, "c", None), (None, "x", None), (None, "y", None)], key=str)
    assert B.merge_dumps([a.where("false"), b.where("false")]).count() == 0
    assert B.merge_dumps([a]).columns == ["booking_id", "status", "amount"]
