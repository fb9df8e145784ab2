import datetime as dt
import random

import pytest

from opslens.operators.customers import core_customers

SCHEMA = ("phone long, status string, requested_date timestamp_ntz, booking_month string, total_revenue double, "
          "successful_bookings long, only_dc string")
# Not in order, one date with two months, one month read twice.
SNAPSHOTS = [("2016-09-01", "2016-08"), ("2016-07-01", "2016-06"), ("2016-09-01", "2016-06"), ("2016-10-01", "2016-09")]


def brute(rows, fix_dc):
    out = {}
    for date, month in SNAPSHOTS:
        as_of = dt.datetime.fromisoformat(date)
        past = {}
        for r in rows:
            if r[0] is not None and r[1] == "closed" and r[2] is not None and r[2] < as_of:
                past.setdefault(r[0], []).append(r)
        users, core_users, gmv, core_gmv = 0, 0, None, 0.0
        for mine in past.values():
            inside = [r for r in mine if r[3] == month]
            if not inside:
                continue
            counted = [r[5] for r in mine if r[5] is not None]
            n = sum(counted) / len(counted) if counted else None
            dc = all(r[6] is not None for r in mine)
            gap = (as_of - min(r[2] for r in mine)).days / n if n else None
            core = n is not None and n > 1 and gap < (60 if dc else 20) and (fix_dc or not dc)
            paid = [r[4] for r in inside if r[4] is not None]
            users, core_users = users + 1, core_users + core
            if paid:
                gmv = (gmv or 0.0) + sum(paid)
                core_gmv += sum(paid) * core
        if users:
            out[as_of, month] = (users, core_users / users, gmv, core_gmv / gmv if gmv else None)
    return out


@pytest.mark.parametrize("fix_dc", [True, False])
def test_core_customers_equal_a_row_by_row_restatement(spark, fix_dc):
    rng = random.Random(8)
    rows = []
    for _ in range(1500):
        at = dt.datetime(2016, 5, 1) + dt.timedelta(hours=rng.randrange(24 * 170))
        # One customer holds a third of the rows; the month is a column of its own and may differ from the date.
        phone = 7 if rng.random() < 0.33 else rng.choice([None, *range(60)])
        month = None if rng.random() < 0.05 else f"{at:%Y-%m}" if rng.random() < 0.9 else "2016-08"
        rows.append((phone, rng.choice(["closed", "closed", "cancelled"]), None if rng.random() < 0.03 else at, month,
                     None if rng.random() < 0.1 else rng.randrange(80) / 8, rng.choice([None, 1, 2, 5, 9]),
                     "dc" if phone is not None and phone % 4 == 0 else rng.choice([None, "dc"])))
    got = core_customers(spark.createDataFrame(rows, SCHEMA), SNAPSHOTS, ["closed"], fix_dc).collect()
    want = brute(rows, fix_dc)
    assert {(r.as_of, r.month) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        users, share, gmv, gmv_share = want[r.as_of, r.month]
        assert (r.users, r.gmv) == (users, gmv)
        assert r.core_share == pytest.approx(share) and r.core_gmv_share == pytest.approx(gmv_share)


def test_no_bookings_give_no_row(spark):
    assert core_customers(spark.createDataFrame([], SCHEMA), SNAPSHOTS).count() == 0
