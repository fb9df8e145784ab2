import os
import tempfile

import pytest
from pyspark.sql import functions as F

from opslens.sources import adapters as A
from opslens.sources import readers, schemas, sinks
from tests.helpers import frame, ts

SF = "/root/testdata/sf0.001"


def folder():
    return os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "out")


def test_csv_is_read_leniently_under_its_own_headers(spark):
    path = folder()
    os.makedirs(path)
    with open(os.path.join(path, "a.csv"), "w") as f:
        f.write("ID,Booking id,Time of creation,Active,City\n1,12.0,02-08-2016 07:59,False,M\n2,x,soon,True,M\n")
    got = readers.read_table(
        spark, "issues", path, ["issue_id", "booking_id", "created_at", "active", "owner"], "csv",
        {"issue_id": "ID", "booking_id": "Booking id", "created_at": "Time of creation", "active": "Active"},
        "dd-MM-yyyy HH:mm", optional=("owner",)).orderBy("issue_id")
    assert got.columns == ["issue_id", "booking_id", "created_at", "active"]
    assert [tuple(r) for r in got.collect()] == [(1, 12, ts("2016-08-02 07:59:00"), False), (2, None, None, True)]


def test_parquet_scan_is_pruned_and_filtered(spark):
    path = folder()
    sinks.write_table(A.calls(spark, SF), path)
    df = readers.read_table(spark, "calls", path, ["call_id", "status"]).where("call_id > 10")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<call_id:bigint,status:string>" in plan
    assert "GreaterThan(call_id,10)" in plan


def test_adapters_follow_the_schemas(spark):
    for name, df in {"bookings": A.bookings(spark, SF), "pickup_visits": A.pickup_visits(spark, SF),
                     "delivery_visits": A.delivery_visits(spark, SF), "calls": A.calls(spark, SF),
                     "agents": A.agents(spark, SF), "issues": A.issues(spark, SF)}.items():
        declared = {f.name: f.dataType for f in schemas.TABLES[name].fields}
        for f in df.schema.fields:
            assert declared[f.name] == f.dataType, (name, f.name)


def test_one_folder_per_group(spark):
    path = folder()
    df = frame(spark, "role string, courier string, n int", [
        {"role": "pickup", "courier": "a", "n": 1}, {"role": "delivery", "courier": "a", "n": 2}, {"role": "pickup", "courier": "b", "n": 3}])
    sinks.write_by_group(df, path, ["role", "courier"])
    assert sorted(os.path.join(r, d).removeprefix(path + "/") for r, ds, _ in os.walk(path) for d in ds if d.startswith("courier")) == [
        "role=delivery/courier=a", "role=pickup/courier=a", "role=pickup/courier=b"]
    assert spark.read.parquet(path).where("role = 'pickup'").agg(F.sum("n")).first()[0] == 4


def test_csv_sink_and_stacked_reports(spark):
    a = frame(spark, "k string, n int", [{"k": "x", "n": 1}])
    b = frame(spark, "k string, m int", [{"k": "y", "m": 2}])
    stacked = sinks.stack_reports({"one": a, "two": b})
    path = folder()
    sinks.write_table(stacked, path, "csv")
    back = spark.read.option("header", True).csv(path).orderBy("variant").collect()
    assert [(r.variant, r.k, r.n, r.m) for r in back] == [("one", "x", "1", None), ("two", "y", None, "2")]


def test_odd_numbers_quotes_and_line_breaks_in_csv(spark):
    path = folder()
    os.makedirs(path)
    with open(os.path.join(path, "a.csv"), "w") as f:
        f.write('number,name\nnan,x\n1e30,x\n9007199254740993,"he said ""no"", twice"\n12.0,"two\nlines"\n')
    got = readers.read_table(spark, "leads", path, fmt="csv", extra=("name",), multi_line=True)
    assert {tuple(r) for r in got.collect()} == {
        (None, "x"), (9007199254740993, 'he said "no", twice'), (12, "two\nlines")}
    with pytest.raises(ValueError, match="issue_id"):
        readers.read_table(spark, "issues", path, ["issue_id"], "csv")


def test_text_in_parquet_is_lenient(spark):
    path = folder()
    frame(spark, "number string", [{"number": "7"}, {"number": "seven"}]).write.parquet(path)
    assert {r.number for r in readers.read_table(spark, "leads", path).collect()} == {7, None}


def test_groups_are_written_by_few_tasks(spark):
    path = folder()
    df = spark.range(0, 4000, 1, 40).select((F.col("id") % 3).cast("string").alias("courier"), "id")
    sinks.write_by_group(df, path, ["courier"])
    files = [f for _, _, fs in os.walk(path) for f in fs if f.startswith("part-")]
    assert 3 <= len(files) <= 6
