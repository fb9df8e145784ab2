import datetime as dt

from pyspark.sql import functions as F

from opslens.functions import columns as X
from opslens.functions import text as T
from opslens.functions import times as M
from opslens.functions.labels import DELIVERY_LATER, DELIVERY_STEPS, PICKUP_REASON_RULES
from tests.helpers import frame, ts


def one(spark, ddl, value, *columns):
    name = ddl.split()[0]
    return spark.createDataFrame([(value,)], f"{name} {ddl.split()[1]}").select(*columns).first()


def test_null_differs_from_everything(spark):
    rows = frame(spark, "a string", [{"a": "x"}, {"a": "y"}, {}]).select(
        "a", X.differs(F.col("a"), "x").alias("d"), X.not_in(F.col("a"), ["x"]).alias("n"),
        X.has_text(F.col("a"), "x").alias("t")).collect()
    assert [(r.d, r.n, r.t) for r in rows] == [(False, False, True), (True, True, False), (True, True, False)]


def test_lenient_numbers_and_zero_denominators(spark):
    r = one(spark, "a string", " 12.5 ", X.to_number(F.col("a")).alias("n"), X.to_number(F.lit("n/a")).alias("bad"),
            X.ratio(F.lit(1), F.lit(0)).alias("z"))
    assert (r.n, r.bad, r.z) == (12.5, None, None)


def test_nps_scores(spark):
    rows = frame(spark, "f double", [{"f": v} for v in (1.0, 2.0, 3.0, 4.0, 5.0, None)]).select(
        X.nps_score(F.col("f")).alias("n"), X.nps_split(X.nps_score(F.col("f"))).alias("s")).collect()
    assert [r.n for r in rows] == [-1, -1, 0, 1, 1, None]
    assert [r.s for r in rows] == ["-ve", "-ve", "+ve", "+ve", "+ve", "+ve"]


def test_null_keys_form_no_group(spark):
    df = frame(spark, "k string, v int", [{"k": "a", "v": 1}, {"v": 2}])
    assert [r.k for r in X.present(df, "k").groupBy("k").count().collect()] == ["a"]


def test_first_present_skips_nulls_in_order(spark):
    df = frame(spark, "k int, v string", [{"k": 2, "v": "b"}, {"k": 1}, {"k": 3, "v": "c"}])
    assert df.agg(X.first_present("v", "k").alias("v")).first().v == "b"


def test_complete_labels_keeps_order_and_gaps(spark):
    counts = frame(spark, "slot string, n int", [{"slot": "b", "n": 2}, {"slot": "z", "n": 9}])
    rows = X.complete_labels(counts, "slot", ["a", "b"], "n").orderBy("ord").collect()
    assert [(r.slot, r.n) for r in rows] == [("a", None), ("b", 2)]


def test_wide_report_has_a_column_per_listed_value(spark):
    df = frame(spark, "k string, c string, v int", [{"k": "a", "c": "x", "v": 1}, {"k": "a", "c": "q", "v": 5}])
    assert X.to_wide(df, ["k"], "c", ["x", "y"], "v").first().asDict() == {"k": "a", "x": 1, "y": None}


def test_reason_rules_apply_in_order(spark):
    raw = ["Not available at the address, called", "far Geographical limit", "not opening the door",
           "Bad WEATHER", "Others ", "NOT able to locate my new address", None, "a\nsome weather\nb"]
    rows = frame(spark, "r string", [{"r": v} for v in raw]).select(
        T.normalise_reason(F.col("r"), PICKUP_REASON_RULES).alias("o")).collect()
    assert [r.o for r in rows] == [
        "not_available_at_the_address", "out_of_geographical_area", "not_opening_the_door",
        "unfavourable_weather_conditions", "Others ", "not_able_to_locate_the_address", None,
        "a\nunfavourable_weather_conditions\nb"]


def test_relabel_keeps_unknown_values(spark):
    rows = frame(spark, "r string", [{"r": "a"}, {"r": "b"}, {}]).select(
        T.relabel(F.col("r"), {"a": "A"}).alias("o")).collect()
    assert [r.o for r in rows] == ["A", "b", None]


def test_list_and_range_texts(spark):
    r = one(spark, "a string", "10 -12", T.range_start(F.col("a")).alias("s"), T.list_length(F.lit("a,b")).alias("n"),
            T.list_length(F.lit(None).cast("string")).alias("z"), T.merge_prefix(F.lit("reschedule_x"), "reschedule").alias("p"))
    assert (r.s, r.n, r.z, r.p) == ("10", 2, None, "reschedule")


WEEKS = [("W1", "2016-08-01", "2016-08-07"), ("W2", "2016-08-08", "2016-08-14"), ("W3", "2016-08-15", "2016-08-21")]


def labels(spark, values, column):
    return [r.o for r in frame(spark, "t timestamp_ntz", [{"t": ts(v)} for v in values]).select(column.alias("o")).collect()]


def test_first_matching_period_takes_the_boundary_midnight(spark):
    days = ["2016-08-08 00:00:00", "2016-08-08 00:00:01", "2016-08-16", "2030-01-01", None]
    assert labels(spark, days, M.period_label(F.col("t"), WEEKS)) == ["W1", "W2", "W3", "W3", "W3"]
    assert labels(spark, days, M.period_label(F.col("t"), WEEKS, "none", end_days=0)) == [
        "W2", "W2", "W3", "none", "none"]


def test_many_periods_give_the_same_labels(spark):
    many = M.weekly_periods(dt.date(2016, 8, 1), 12)
    days = ["2016-08-08 00:00:00", "2016-08-10", "2016-10-20 12:00:00", "2030-01-01", None]
    got = labels(spark, days, M.period_label(F.col("t"), many))
    assert got == ["W1", "W2", "W12", "W12", "W12"]


def test_step_weeks_are_half_open(spark):
    start = dt.date(2016, 8, 8)
    got = labels(spark, ["2016-07-01", "2016-08-15", "2016-08-14 23:59:59", "2017-01-01", None],
                 M.step_week_label(F.col("t"), start))
    assert got == ["Aug-08 to Aug-14", "Aug-15 to Aug-21", "Aug-08 to Aug-14", "Aug-29 to Sep-04", "Aug-29 to Sep-04"]


def test_iso_week(spark):
    assert labels(spark, ["2016-01-01"], M.iso_week_label(F.col("t"))) == ["W53"]


def test_slot_edges_are_inclusive_and_missing_is_late(spark):
    at = ["10:00", "10:30", "11:00", "11:30", "12:00", "13:00", "14:00", "14:01"]
    start = F.lit("2016-08-08 10:00:00").cast("timestamp_ntz")
    got = labels(spark, [f"2016-08-08 {h}:00" for h in at] + [None],
                 M.slot_label(F.col("t"), start, DELIVERY_STEPS, DELIVERY_LATER))
    assert got == [name for _, name in DELIVERY_STEPS] + [DELIVERY_LATER, DELIVERY_LATER]


def test_slot_start_needs_a_readable_day_and_hour(spark):
    df = frame(spark, "d string, h string", [
        {"d": "2016-08-08", "h": "9 "}, {"d": "soon", "h": "9"}, {"d": "2016-08-08", "h": "x"}, {"d": "2016-08-08", "h": "25"}])
    got = [r.o for r in df.select(M.slot_start(F.col("d"), F.col("h")).alias("o")).collect()]
    assert got == [dt.datetime(2016, 8, 8, 9), None, None, None]


def test_time_differences(spark):
    a, b = (F.lit(v).cast("timestamp_ntz") for v in ("2016-01-01 00:00:00.5", "2016-01-03 00:00:00.25"))
    r = spark.range(1).select(
        M.clock_seconds(a, b).alias("c"), M.whole_days_between(a, b).alias("d"), M.whole_days_between(b, a).alias("n"),
        M.seconds_between(a, b).cast("double").alias("s")).first()
    assert (r.c, r.d, r.n, r.s) == (86399, 1, -2, 172799.75)


def test_day_first_text(spark):
    r = one(spark, "a string", "02-08-2016 07:59", M.read_time(F.col("a"), "dd-MM-yyyy HH:mm").alias("t"),
            M.read_time(F.lit("n/a")).alias("bad"))
    assert (r.t, r.bad) == (dt.datetime(2016, 8, 2, 7, 59), None)
