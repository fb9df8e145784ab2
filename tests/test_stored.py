"""Reports from stored customer histories: same rows as from the bookings, and no exchange by customer."""

import re

import pytest
from pyspark.sql import functions as F

from opslens.operators import bookings as B
from opslens.operators import cohorts as K
from opslens.operators import customers as U
from opslens.plans import stored as S
from opslens.sources import adapters as A

SNAPSHOTS = [("1996-07-01", "1996-06"), ("1998-01-01", "1997-12"), ("1998-01-01", "1997-11")]
REPORTS = {
    "matrix": (K.cohort_matrix, S.cohort_matrix),
    "variants": (lambda b: K.cohort_variants(b, excluded=["1995-01"]), lambda h: S.cohort_variants(h, excluded=["1995-01"])),
    "core": (lambda b: U.core_customers(b, SNAPSHOTS), lambda h: S.core_customers(h, SNAPSHOTS)),
    "core_as_reported": (lambda b: U.core_customers(b, SNAPSHOTS, fix_dc=False),
                         lambda h: S.core_customers(h, SNAPSHOTS, fix_dc=False)),
    "marketing": (lambda b: U.marketing_master(b, as_of="2001-08-15"), lambda h: S.marketing_master(h, as_of="2001-08-15")),
}


@pytest.fixture(scope="module")
def enriched(spark, tmp_path_factory):
    """A third of the rows are one customer's; some have no phone, date, city or feedback."""
    rows = A.bookings(spark, "/root/testdata/sf0.001")
    n = F.col("booking_id")
    rows = rows.withColumns({
        "phone": F.when(n % 3 == 0, F.lit("7")).when(n % 31 == 0, None).otherwise(F.col("phone").cast("string")).cast(
            rows.schema["phone"].dataType),
        "requested_date": F.when(n % 41 != 0, F.col("requested_date")),
        "city": F.when(n % 37 != 0, F.col("city")), "feedback": F.when(n % 5 != 0, F.col("feedback"))})
    path = str(tmp_path_factory.mktemp("enriched"))
    B.enrich_customers(B.with_revenue(rows), duplicates=False).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def kept(enriched, tmp_path_factory):
    return S.store(S.histories(enriched), "histories_test", 5, str(tmp_path_factory.mktemp("kept")))


def lines(df):
    return sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


@pytest.mark.parametrize("name", list(REPORTS))
def test_same_rows_as_from_the_bookings(enriched, kept, name):
    plain, stored = REPORTS[name]
    want, got = plain(enriched), stored(kept)
    assert dict(want.dtypes) == dict(got.dtypes)
    assert lines(want) == lines(got) and lines(got)


@pytest.mark.parametrize("name", list(REPORTS))
def test_no_exchange_on_phone(kept, name):
    plan = REPORTS[name][1](kept)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    assert not re.search(r"hashpartitioning\([^)]*phone", plan), plan


def test_city_and_sizes(enriched, kept):
    city = enriched.where("city is not null").first()["city"]
    assert lines(K.cohort_variants(enriched, city)) == lines(S.cohort_variants(kept, city))
    assert lines(U.marketing_master(enriched, city, "2001-08-15")) == lines(S.marketing_master(kept, city, "2001-08-15"))
    busiest = "phone = '7'"
    assert kept.where(busiest).count() <= enriched.where(busiest).count()


def test_no_bookings(spark, enriched, tmp_path):
    empty = S.store(S.histories(enriched.limit(0)), "histories_empty", 2, str(tmp_path / "kept"))
    for _, stored in REPORTS.values():
        assert stored(empty).collect() == []
