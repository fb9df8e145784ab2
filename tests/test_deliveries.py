import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from opslens.operators import deliveries as D
from opslens.operators import pickups as P
from opslens.operators import skew
from opslens.sources import adapters as A
from tests.helpers import by, frame, ts

SF = "/root/testdata/sf0.001"
DDL = """visit_id bigint, booking_id bigint, city string, requested_date string, requested_time string,
updation_time timestamp_ntz, creation_time timestamp_ntz, cancellation_time timestamp_ntz,
visit_cancel_reason string, visit_status string, ofd_happened_at string"""


def assigned_by_hand(visits):
    """The assignment rules, visit by visit, for one booking."""
    visits = sorted(visits, key=lambda v: v["visit_id"])
    listed = next((v["ofd_happened_at"] for v in visits if v["ofd_happened_at"]), None)
    done = any(v["visit_status"] == "done" for v in visits)
    out = {v["visit_id"]: None for v in visits}
    if listed is None and not done:
        return out
    if listed is None:
        listed = max(v["creation_time"] for v in visits).strftime("%Y-%m-%d %H:%M:%S")
    stamps = [dt.datetime.fromisoformat(s) for s in listed.split(",")]
    last, waiting = stamps[-1], stamps[:-1]
    for v in visits:
        if v["visit_status"] == "done":
            out[v["visit_id"]] = last
    for v in visits:
        if waiting and v["cancellation_time"] is not None and v["cancellation_time"] >= waiting[0]:
            out[v["visit_id"]] = waiting.pop(0)
    return out


def random_visits(seed, bookings, most):
    rng = random.Random(seed)
    base = dt.datetime(2016, 8, 1)

    def moment():
        return base + dt.timedelta(hours=rng.randrange(200))

    out = []
    for b in range(bookings):
        stamps = ",".join(str(moment()) for _ in range(rng.randrange(1, 6))) if rng.random() < .8 else None
        for i in range(rng.randrange(1, most)):
            out.append({
                "visit_id": b * 1000 + i * 5 + rng.randrange(5), "booking_id": b,
                "creation_time": moment(), "cancellation_time": moment() if rng.random() < .8 else None,
                "visit_status": rng.choice(["done", "cancelled", "cancelled"]), "ofd_happened_at": stamps})
    return out


@pytest.mark.parametrize("limits", [
    {}, {"heavy_rows": 3}, {"heavy_visits": 0, "slice_ids": 5}, {"heavy_rows": 3, "heavy_visits": 6, "slice_ids": 7}])
def test_assignment_matches_the_rules_visit_by_visit(spark, limits):
    visits = random_visits(3, 150, 14)
    expected = {}
    for b in {v["booking_id"] for v in visits}:
        expected.update(assigned_by_hand([v for v in visits if v["booking_id"] == b]))
    got = {r.visit_id: r.ofd_time for r in D.assign_ofd(frame(spark, DDL, visits), **limits).collect()}
    assert got == expected


def visit(i, b, **more):
    return {"visit_id": i, "booking_id": b, "creation_time": ts("2016-08-08 09:00:00"), "visit_status": "cancelled", **more}


def test_last_stamp_is_used_up_without_a_done_visit(spark):
    got = by(D.assign_ofd(frame(spark, DDL, [
        visit(1, 1, ofd_happened_at="2016-08-08 10:00:00", cancellation_time=ts("2016-08-08 12:00:00")),
        visit(2, 2, visit_status="done"), visit(3, 3), visit(4, None, visit_status="done")])), "visit_id")
    assert set(got) == {1, 2, 3}
    assert got[1]["ofd_time"] is None and got[1]["ofd_attempts"] == 1
    assert got[2]["ofd_time"] == ts("2016-08-08 09:00:00") and got[2]["ofd_attempts"] == 1
    assert got[2]["ofd_happened_at"] == "2016-08-08 09:00:00"
    assert got[3]["ofd_time"] is None and got[3]["ofd_attempts"] is None


def test_delivery_funnel_parts_add_up(spark):
    lines = D.delivery_funnel(A.delivery_visits(spark, SF), "1995-01-01", "2003-12-31", dt.date(1998, 6, 1))
    got = by(lines, "week", "ord", "metric")
    weeks = {k[0] for k in got}
    assert len(weeks) == 4
    for w in weeks:
        v = {k[1:]: r["value"] for k, r in got.items() if k[0] == w}
        assert v[2, "ofd_visits"] + v[3, "not_ofd_visits"] == v[1, "total_visits"]
        assert v[5, "ofd_unsuccessful"] == v[2, "ofd_visits"] - v[4, "successful_deliveries"]
        assert v[9, "single_ofd"] + v[12, "multiple_ofd"] == v[15, "total_bookings"]
        lost = sum(x or 0 for k, x in v.items() if k[0] == 8)
        assert lost <= v[2, "ofd_visits"]
        assert len([k for k in v if k[0] == 11]) == 8


def test_delivery_funnel_counts_bookings_once_and_keeps_empty_labels_null(spark):
    done = dict(visit_status="done", requested_date="2016-08-08", requested_time="10-12",
                updation_time=ts("2016-08-08 10:20:00"), ofd_happened_at="2016-08-08 09:30:00")
    lines = D.delivery_funnel(frame(spark, DDL, [
        visit(1, 1, **done), visit(2, 1, **done), visit(3, 2, **{**done, "requested_date": None}),
        visit(4, 3, visit_cancel_reason="Cash not available now"), visit(5, 4, visit_status="scheduled"),
        visit(6, 5, **{**done, "creation_time": ts("2016-09-09")}),
    ]), "2016-08-08", "2016-09-04", dt.date(2016, 8, 8))
    v = {(r.ord, r.metric): r.value for r in lines.collect()}
    assert {r.week for r in lines.collect()} == {"Aug-08 to Aug-14"}
    assert (v[1, "total_visits"], v[2, "ofd_visits"], v[4, "successful_deliveries"]) == (4, 3, 3)
    assert v[7, "cash_not_available"] == 1
    assert (v[9, "single_ofd"], v[10, "without_slot"], v[15, "total_bookings"]) == (2, 1, 2)
    assert (v[11, "T_T+0.5"], v[11, "<T"], v[8, "<T"], v[12, "multiple_ofd"]) == (1, None, None, 0)


def test_first_version_sums_attempts_of_done_rows(spark):
    rows = [visit(1, 1, visit_status="done", ofd_happened_at="a,b", requested_date="2016-08-08", requested_time="8-10",
                  updation_time=ts("2016-08-08 09:30:00")),
            visit(2, 1), visit(3, 2, visit_status="done"), visit(4, 3, visit_status="open")]
    for limits in ({}, {"heavy_rows": 0}):
        v = {(r.ord, r.metric): r.value for r in D.delivery_funnel_v1(
            frame(spark, DDL, rows), "2016-08-08", "2016-08-08", **limits).collect()}
        assert (v[1, "total_visits"], v[2, "ofd_visits"], v[3, "not_ofd_visits"]) == (4, 2, 2)
        assert (v[4, "successful_deliveries"], v[5, "ofd_unsuccessful"]) == (2, 0)
        assert (v[6, "single_ofd"], v[9, "multiple_ofd"], v[11, "t+1-t+2"], v[11, ">t+4"]) == (0, 1, 1, None)


BOOKINGS = """booking_id bigint, city string, status string, requested_date timestamp_ntz, cancel_reason string,
booking_cancel_reason string, cancelled_pickup_visits double"""
VISITS = """booking_id bigint, city string, requested_date timestamp_ntz, requested_time string,
updation_time timestamp_ntz, creation_time timestamp_ntz, cancellation_time timestamp_ntz,
visit_cancel_reason string, visit_status string"""


def test_pickup_funnel_by_hand(spark):
    day = ts("2016-08-30")

    def b(i, **more):
        return {"booking_id": i, "city": "M", "status": "cancelled", "requested_date": day, "cancelled_pickup_visits": 0.0, **more}

    def v(i, **more):
        return {"booking_id": i, "city": "M", "requested_date": day, "requested_time": "10-12", "visit_status": "done",
                "creation_time": ts("2016-08-30 09:00:00"), **more}

    bookings = frame(spark, BOOKINGS, [
        b(1, cancel_reason="reschedule_a"), b(2, cancel_reason="wrong", booking_cancel_reason="x"),
        b(3, cancel_reason="customer_cancellation"), b(4, cancel_reason="stock_out"), b(5),
        b(6, cancelled_pickup_visits=1.0), b(7, cancelled_pickup_visits=2.0), b(8, status="closed"),
        b(9, status="closed"), b(10, status="closed", city="D"), b(11, status="new"),
        b(12, cancel_reason="reschedule_stock_out", cancelled_pickup_visits=None)])
    visits = frame(spark, VISITS, [
        v(6, visit_status="cancelled", visit_cancel_reason="Not available at the address!", cancellation_time=ts("2016-08-30 10:30:00")),
        v(6, visit_status="cancelled", visit_cancel_reason="flood"),
        v(7, visit_status="cancelled", visit_cancel_reason="flood"),
        v(8, updation_time=ts("2016-08-30 10:00:00")), v(9, updation_time=ts("2016-08-30 12:30:00")),
        v(9, updation_time=ts("2016-08-30 12:30:00"), creation_time=None),
        v(12, visit_status="cancelled"), v(99)])
    got = {(r.ord, r.metric): r.value for r in P.pickup_funnel(bookings, visits, "2016-08-29", "2016-09-04", "M").collect()}
    n = {k: None if x is None else round(x * 10) for k, x in got.items() if k[0] < 16}
    assert got[16, "Requested_abs"] == 10
    assert (n[2, "reschedule"], n[2, "others"], n[2, "out_of_geographical_area"], n[3, "x"]) == (1, 1, 0, 1)
    assert (n[4, "pre_visit_SO/RSO"], n[5, "post_visit_SO/RSO"], n[6, "ppvc2"], n[7, "ppvc1"]) == (1, 1, 1, 1)
    assert (n[8, "not_available_at_the_address"], n[8, "Others "], n[9, "everything_else"]) == (1, None, 1)
    assert (n[10, "t-t+1"], n[10, ">t+2"]) == (1, None)
    assert (n[11, "before_slot_pikcup"], n[12, "within_slot_pickup"], n[13, "t+2-t+3"]) == (0, 1, 1)
    assert (n[14, "<t"], n[14, ">t+1"], n[15, "bookings_with_creation_time>t+1_single_visit"]) == (1, 1, 1)


def test_visit_slots_of_other_statuses_are_null(spark):
    r = P.visit_slot(frame(spark, VISITS, [{"booking_id": 1, "requested_date": ts("2016-08-30"), "requested_time": "10-12",
                                            "visit_status": "open"}])).first()
    assert (r.updation_slot, r.creation_slot) == (None, None)


def test_rows_of_a_visit_listed_twice_take_a_stamp_each(spark):
    one = {"visit_id": 1, "booking_id": 7, "visit_status": "cancelled", "cancellation_time": ts("2016-08-05 12:00:00"),
           "ofd_happened_at": "2016-08-05 09:00:00,2016-08-05 10:00:00,2016-08-05 18:00:00"}
    got = D.assign_ofd(frame(spark, DDL, [one, one])).collect()
    assert sorted(r.ofd_time for r in got) == [ts("2016-08-05 09:00:00"), ts("2016-08-05 10:00:00")]


def test_a_booking_with_a_third_of_the_visits_is_cut(spark):
    rng = random.Random(9)
    base = dt.datetime(2016, 8, 1)
    stamps = ",".join(str(base + dt.timedelta(hours=h)) for h in sorted(rng.sample(range(300), 40)))
    hot = [{"visit_id": i // 2, "booking_id": 5000, "visit_status": rng.choice(["done", "cancelled"]), "ofd_happened_at": stamps,
            "creation_time": base, "cancellation_time": rng.choice([None, base + dt.timedelta(hours=i // 2)])} for i in range(0, 900, 2)]
    visits = hot + random_visits(4, 130, 14)
    df = frame(spark, DDL, visits)
    order = [F.col("visit_id")]
    slices = skew.cut(df, "booking_id", order, "_slice").groupBy("booking_id").agg(F.count_distinct("_slice").alias("n"))
    assert slices.where("booking_id = 5000").first().n > 2
    got = {(r.booking_id, r.visit_id): r.ofd_time for r in D.assign_ofd(df).collect()}
    for b in {v["booking_id"] for v in visits}:
        for visit, stamp in assigned_by_hand([v for v in visits if v["booking_id"] == b]).items():
            assert got[b, visit] == stamp


def test_visits_are_dealt_before_they_are_gathered_and_matched_before_they_are_listed(spark):
    df = D.assign_ofd(A.delivery_visits(spark, SF))
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    gather = next(i for i, line in enumerate(plan) if "partial_collect_list(struct(visit" in line)
    assert "Exchange hashpartitioning(booking_id" in plan[gather + 1]  # nothing is sorted or gathered where rows are read
    listing = next(line for line in plan if "Generate posexplode(visits" in line)
    assert "visits#" not in listing.split("), [", 1)[1]  # no visit carries the whole list


def test_oversized_keys_are_known_before_they_are_looked_for(spark):
    stats = frame(spark, "k bigint, n_rows bigint", [{"k": i, "n_rows": 2} for i in range(400)] + [{"k": 999, "n_rows": 90}])
    for limits in ({}, {"floor": 89}, {"floor": 90}, {"floor": 2, "most": 5}, {"most": 1}, {"most": 91}):
        for rows in (stats, stats.where("k <> 999"), stats.where("k < 0")):
            found = rows.agg(F.count("*")).select(skew.any_oversized(rows, **limits).alias("some")).first().some
            assert bool(found) == (skew.heaviest(rows, "k", **limits).count() > 0)


def test_the_funnel_deals_visits_without_their_week(spark):
    lines = D.delivery_funnel(A.delivery_visits(spark, SF), "1995-01-01", "2003-12-31", dt.date(1998, 6, 1))
    plan = lines._jdf.queryExecution().optimizedPlan().toString().split("\n")
    gather = next(line for line in plan if "collect_list(struct(visit" in line and "rest" in line)
    assert "week" not in gather
