import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslens.operators import calls as C
from opslens.operators import issues as I
from opslens.operators import skew
from opslens.operators.quantiles import distribution
from opslens.sources import adapters as A
from tests.helpers import by, frame, ts

CALLS = "call_id bigint, phone string, direction string, status string, start_time timestamp_ntz, billable_duration double"


def called_back_by_hand(calls):
    """The callback rules, call by call, for one phone."""
    calls = sorted(calls, key=lambda c: (c["start_time"], c["call_id"]))
    out = {c["call_id"]: (None, None) for c in calls}
    is_open, since = False, None
    for c in calls:
        how = None
        if not is_open:
            if c["status"] == "missed-call":
                is_open, since = True, c["start_time"]
            continue
        if c["direction"] == "inbound" and c["status"] == "completed":
            how = "inb"
        elif c["direction"] == "outbound":
            how = "out_success" if c["status"] == "completed" else "out_fail"
        if how:
            is_open = False
            out[c["call_id"]] = (how, (c["start_time"] - since).seconds / 60.0)
    if is_open:
        last = max((c for c in calls if c["status"] == "missed-call"), key=lambda c: (c["start_time"], -c["call_id"]))
        out[last["call_id"]] = ("no_callback", out[last["call_id"]][1])
    return out


def random_calls(seed, phones, most, step):
    rng = random.Random(seed)
    out = []
    for p in range(phones):
        at = dt.datetime(2024, 1, 1)
        for i in range(rng.randrange(1, most)):
            at += dt.timedelta(seconds=rng.choice([0, 1, 7, step]) * rng.randrange(0, 50), microseconds=rng.randrange(3))
            out.append({"call_id": p * 1000 + i, "phone": str(p), "start_time": at,
                        "direction": rng.choice(["inbound", "outbound"]),
                        "status": rng.choice(["missed-call", "completed", "unsuccessful"])})
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("limits", [{}, {"slice_seconds": 300}, {"slice_seconds": 20_000}, {"slice_seconds": 10**10}])
def test_callbacks_match_the_rules_call_by_call(spark, limits):
    calls = random_calls(5, 250, 30, 2000)
    expected = {}
    for p in {c["phone"] for c in calls}:
        expected.update(called_back_by_hand([c for c in calls if c["phone"] == p]))
    rows = C.callback_status(frame(spark, CALLS, calls), **limits).collect()
    assert {r.call_id: (r.callback_status, r.callback_minutes) for r in rows} == expected


def test_a_phone_with_a_third_of_all_calls_on_one_day_is_cut(spark):
    calls = random_calls(6, 60, 25, 2000)
    n = len(calls)
    hot = [dict(c, call_id=10**6 + i, phone="hot") for i, c in enumerate(random_calls(7, 40, 25, 2000)[:n // 2])]
    df = frame(spark, CALLS, calls + hot)
    assert skew.cut(df, "phone", [F.col("start_time"), F.col("call_id")], "_slice").where("phone = 'hot'").select(
        "_slice").distinct().count() > 1
    expected = called_back_by_hand(hot)
    for p in {c["phone"] for c in calls}:
        expected.update(called_back_by_hand([c for c in calls if c["phone"] == p]))
    rows = C.callback_status(df).collect()
    assert {r.call_id: (r.callback_status, r.callback_minutes) for r in rows} == expected


def call(i, direction, status, at):
    return {"call_id": i, "phone": "1", "direction": direction, "status": status, "start_time": ts(at)}


def test_wait_counts_the_part_below_a_day(spark):
    df = frame(spark, CALLS, [call(1, "inbound", "missed-call", "2024-01-01 10:00:00"),
                              call(2, "inbound", "completed", "2024-01-02 11:00:00")])
    assert by(C.callback_status(df), "call_id")[2]["callback_minutes"] == 60
    assert by(C.callback_status(df, total_seconds=True), "call_id")[2]["callback_minutes"] == 25 * 60


def test_outbound_missed_call_opens_when_idle_and_closes_when_open(spark):
    df = frame(spark, CALLS, [call(1, "outbound", "missed-call", "2024-01-01 10:00:00"),
                              call(2, "inbound", "missed-call", "2024-01-01 10:05:00"),
                              call(3, "outbound", "missed-call", "2024-01-01 10:10:00"),
                              call(4, "inbound", "missed-call", "2024-01-01 11:00:00"),
                              call(5, "inbound", "unsuccessful", "2024-01-01 11:05:00")])
    got = by(C.callback_status(df), "call_id")
    assert [(got[i]["callback_status"], got[i]["callback_minutes"]) for i in range(1, 6)] == [
        (None, None), (None, None), ("out_fail", 10.0), ("no_callback", None), (None, None)]


def test_preparation_keeps_inbound_and_agents(spark):
    calls = frame(spark, """call_id bigint, direction string, from_number string, to_number string, status string,
        start_time timestamp_ntz, billable_duration double""", [
        {"call_id": 1, "direction": "inbound", "from_number": "c1", "to_number": "d", "status": "busy", "start_time": ts("2024-01-01")},
        {"call_id": 2, "direction": "outbound-api", "from_number": "a1", "to_number": "c2", "status": "failed", "start_time": ts("2024-01-02")},
        {"call_id": 3, "direction": "outbound-dial", "from_number": "zz", "to_number": "c2", "status": "completed", "start_time": ts("2024-01-02")},
        {"call_id": 4, "direction": "inbound", "from_number": "c1", "to_number": "d", "status": "busy", "start_time": ts("2024-01-09")}])
    agents = frame(spark, "number string", [{"number": "a1"}, {"number": "a1"}])
    rows = C.prepare_calls(calls, agents, "2024-01-01", "2024-01-07").orderBy("call_id").collect()
    assert [(r.call_id, r.phone, r.direction, r.status) for r in rows] == [
        (1, "c1", "inbound", "unsuccessful"), (2, "c2", "outbound", "unsuccessful")]


def frt_by_hand(created, minutes):
    if created.hour >= 22:
        start = dt.datetime.combine(created.date() + dt.timedelta(days=1), dt.time(8))
    elif created.hour <= 7:
        start = dt.datetime.combine(created.date(), dt.time(8))
    else:
        start = created
    m = minutes - (start - created).seconds / 60.0
    return m - 600 * ((start + dt.timedelta(minutes=m)).date() - start.date()).days


def test_business_hours_match_the_rules(spark):
    rng = random.Random(2)
    created = [ts("2024-01-05 22:00:00"), ts("2024-01-05 07:59:00"), ts("2024-01-05 08:00:00"), ts("2024-01-05 21:59:59")]
    created += [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(25 * 86400)) for _ in range(400)]
    minutes = [30.0, 5.0, 0.0, 700.0] + [round(rng.random() * 4000, 2) for _ in range(400)]
    rows = [{"issue_id": i, "created_at": c, "first_response_min": str(m)} for i, (c, m) in enumerate(zip(created, minutes))]
    weeks = [("W1", "2024-01-01", "2024-01-10"), ("W2", "2024-01-11", "2024-01-31")]
    got = by(I.business_frt(frame(spark, "issue_id bigint, created_at timestamp_ntz, first_response_min string", rows), weeks), "issue_id")
    assert len(got) == len(rows)
    for i, (c, m) in enumerate(zip(created, minutes)):
        assert got[i]["first_response_min"] == pytest.approx(frt_by_hand(c, m), abs=1e-6)
        assert got[i]["week"] == ("W1" if c <= dt.datetime(2024, 1, 11) else "W2")


def test_response_before_opening_gives_the_closed_minutes_back(spark):
    row = [{"issue_id": 1, "created_at": ts("2024-01-05 23:00:00"), "first_response_min": "10"},
           {"issue_id": 2, "created_at": ts("2024-01-05 23:00:00"), "first_response_min": "n/a"}]
    got = by(I.business_frt(frame(spark, "issue_id bigint, created_at timestamp_ntz, first_response_min string", row),
                            [("W1", "2024-01-01", "2024-01-31")]), "issue_id")
    assert got[1]["first_response_min"] == 10 - 540 + 600
    assert got[2]["first_response_min"] is None


def test_quantiles_equal_linear_interpolation(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.choice([None, round(rng.gauss(0, 50), 1), float(rng.randrange(5))])) for _ in range(3000)]
    rows += [("one", 3.0), ("none", None), (None, 1.0)]
    got = by(distribution(spark.createDataFrame(rows, "k string, v double"), ["k"], "v"), "k")
    assert set(got) == {"a", "b", "c", "one", "none"}
    assert (got["none"]["n"], got["none"]["mean"], got["none"]["p50"]) == (1, None, None)
    for k in ("a", "b", "c", "one"):
        values = [v for kk, v in rows if kk == k and v is not None]
        assert got[k]["n"] == len([1 for kk, _ in rows if kk == k])
        assert got[k]["mean"] == pytest.approx(np.mean(values))
        for name, q in (("p10", .1), ("p25", .25), ("p50", .5), ("p75", .75), ("p80", .8), ("p90", .9)):
            assert got[k][name] == pytest.approx(np.quantile(values, q))


def test_quantiles_of_a_skewed_column(spark):
    df = spark.range(20_000).select(F.lit("w").alias("k"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    values = [5.0 if i % 3 == 0 else float(i) for i in range(20_000)]
    r = distribution(df, ["k"], "v").first()
    assert (r.p10, r.p90) == pytest.approx((np.quantile(values, .1), np.quantile(values, .9)))


def test_resolution_drops_subtypes_by_original_spelling(spark):
    ddl = "issue_id bigint, l2_subtype string, closed_at timestamp_ntz, active boolean, hours_to_close string"
    rows = [{"issue_id": i, "l2_subtype": s, "closed_at": ts("2024-01-02"), "active": a, "hours_to_close": h} for i, (s, a, h) in enumerate([
        ("Refund", False, "1"), ("refund", False, "2"), ("Pickup", False, "n/a"), ("Pickup", True, "5"), (None, False, "3")])]
    got = by(I.resolution_time(frame(spark, ddl, rows), [("W1", "2024-01-01", "2024-01-07")], "2024-01-01", "2024-01-07"), "l2_subtype")
    assert {k: (v["n"], v["mean"]) for k, v in got.items()} == {"refund": (1, 2.0), "pickup": (1, None)}


def test_issue_shares_sum_to_the_labelled_part(spark):
    weeks = [("W5", "2024-01-01", "2024-01-14"), ("W6", "2024-01-15", "2024-02-28")]
    shares = I.issue_share(I.prepare_issues(A.issues(spark, "/root/testdata/sf0.001")), weeks)
    for r in shares.groupBy("l2_subtype", "week").agg(F.sum("issues").alias("n"), F.max("total").alias("t"), F.sum("pct").alias("p")).collect():
        assert r.n <= r.t and r.p == pytest.approx(100.0 * r.n / r.t)


@pytest.mark.parametrize("heavy", [0, 10**6])
def test_requested_date_of_known_bookings_only(spark, heavy):
    issues = frame(spark, "issue_id bigint, booking_id bigint", [
        {"issue_id": i, "booking_id": 1 if i % 2 else i} for i in range(2, 12)] + [{"issue_id": 99}])
    bookings = frame(spark, "booking_id bigint, requested_date timestamp_ntz", [
        {"booking_id": 1, "requested_date": ts("2016-01-01")}, {"booking_id": 4, "requested_date": ts("2016-01-04")}, {"booking_id": 6}])
    got = by(I.with_requested_date(issues, bookings, heavy_rows=heavy), "issue_id")
    assert {k: v["requested_date"] for k, v in got.items()} == {
        **{i: ts("2016-01-01") for i in (3, 5, 7, 9, 11)}, 4: ts("2016-01-04"), 6: None}
