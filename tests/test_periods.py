import datetime as dt
import random

import pytest

from opslens.operators.periods import with_period

from .helpers import ts

PERIODS = "ord int, label string, start timestamp_ntz, end timestamp_ntz"
ROWS = "id int, at timestamp_ntz, label string"


def brute(at, periods, end_days, default):
    for _, label, a, z in sorted((p for p in periods if p[2] and p[3]), key=lambda p: p[:2]):
        if at is not None and a <= at <= z + dt.timedelta(days=end_days):
            return label
    return default


def labels(spark, times, periods, **options):
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(times)], ROWS)
    out = with_period(df, "at", spark.createDataFrame(periods, PERIODS), "week", **options).collect()
    assert len(out) == len(times) and {r["label"] for r in out} <= {"own"}
    return [r["week"] for r in sorted(out, key=lambda r: r["id"])]


@pytest.mark.parametrize("end_days", [0, 1])
def test_first_match_equals_a_search_of_the_whole_table(spark, end_days):
    rng = random.Random(5)
    base = dt.datetime(2020, 1, 1)
    periods = []
    for i in range(150):
        a = base + dt.timedelta(hours=rng.randrange(0, 24 * 60))
        periods.append((rng.randrange(40), f"p{i}", a, a + dt.timedelta(minutes=rng.randrange(-600, 6000))))
    periods += periods[:10] + [(0, "open", None, base), (0, "endless", base, None)]
    times = [None] + [base + dt.timedelta(minutes=rng.randrange(-3000, 24 * 60 * 70)) for _ in range(400)]
    times += [p[2] for p in periods[:40]] + [p[3] + dt.timedelta(days=end_days) for p in periods[:40]]
    times += [times[7]] * 300
    assert labels(spark, times, periods, end_days=end_days, default="else") == [
        brute(t, periods, end_days, "else") for t in times]


def test_bounds_default_and_empty_tables(spark):
    week = [(1, "W1", ts("2016-08-01"), ts("2016-08-07")), (2, "W2", ts("2016-08-07"), ts("2016-08-14"))]
    times = [ts("2016-08-08T00:00:00"), ts("2016-08-08T00:00:01"), ts("2016-07-31T23:59:59"), None]
    assert labels(spark, times, week) == ["W1", "W2", None, None]
    assert labels(spark, times, [], default="x") == ["x"] * 4
    assert labels(spark, [], week) == []


def test_periods_over_the_same_days_leave_one_entry(spark):
    from opslens.operators.periods import _binned

    same = [(i, f"p{i}", ts("2016-08-01"), ts("2016-08-03")) for i in range(500)]
    days = _binned(spark.createDataFrame(same, PERIODS), 1).collect()
    # The last instant of the last day is a cut of its own.
    assert len(days) == 4 and all(len(r["_list"]) == 1 for r in days)
