"""Registered queries of this subpackage against their SQL, value by value."""

import pathlib

import duckdb
import pytest

from opslens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in pathlib.Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield con
    con.close()


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=key)
    assert got == sorted(cursor.fetchall(), key=key) and got
