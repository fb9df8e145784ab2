"""Every registered query against its SQL counterpart, value by value."""

import ast
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry_point
from opslens.plans import reports
from opslens.sources import adapters as A
from registry.oracles import ORACLES
from registry.queries import EVENT_WEEKS, QUERIES

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
         "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_point.queries()) and set(ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    types = {c[0]: str(c[1]) for c in cursor.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    columns = sorted(df.columns)
    at = [list(types).index(c) for c in columns]

    def ordered(rows):
        return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))

    got = ordered(tuple(r[c] for c in columns) for r in df.collect())
    assert got == ordered(tuple(r[i] for i in at) for r in cursor.fetchall())
    assert got


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).limit(1).count() == 1


def test_report_chains_run_end_to_end(spark):
    b = A.bookings(spark, SF)
    newer, older = b.where("booking_id % 3 <> 0"), b.where("booking_id % 3 <> 1")
    for name, df in reports.monthly_business_report(reports.enriched_bookings(newer, older)).items():
        assert df.limit(1).count() == 1, name
    chain = reports.call_centre_report(A.calls(spark, SF), A.agents(spark, SF), A.issues(spark, SF), EVENT_WEEKS)
    for name, df in chain.items():
        assert df.limit(1).count() == 1, name


def test_operators_stay_on_spark():
    """No Python UDF, no driver-side collection, no local checkpoint and no RDD in the library."""
    banned = {"collect", "toPandas", "toLocalIterator", "localCheckpoint", "crossJoin", "udf", "pandas_udf",
              "applyInPandas", "mapInPandas", "rdd", "take"}
    root = pathlib.Path(__file__).parent.parent.joinpath("opslens")
    for path in root.rglob("*.py"):
        if path.relative_to(root).parts[0] == "llm":  # the training-data operators have rules of their own
            continue
        used = {n.attr for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Attribute)}
        assert not used & banned, (path, used & banned)
