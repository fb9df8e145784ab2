"""Call preparation, missed-call callbacks and handling times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import holds, null_if_zero, present, ratio
from ..functions.labels import CALL_STATUS_MAP, DIRECTION_MAP
from ..functions.text import relabel
from ..functions.times import clock_seconds, in_period, moment, seconds_between
from . import skew
from .quantiles import distribution


def prepare_calls(calls: DataFrame, agents: DataFrame, start=None, end=None) -> DataFrame:
    """Fold directions and statuses, keep inbound and agents' calls, and name the customer's phone.

    ``agents`` has one column ``number``. Spark broadcasts it when it is small
    and joins by shuffle otherwise.
    """
    known = agents.select(F.col("number").alias("_agent")).distinct()
    rows = calls
    if start is not None:
        rows = rows.where(in_period(F.col("start_time"), start, end))
    rows = rows.withColumn("direction", relabel(F.col("direction"), DIRECTION_MAP)).withColumn(
        "status", relabel(F.col("status"), CALL_STATUS_MAP))
    inbound = F.col("direction") == "inbound"
    rows = rows.join(known, F.col("from_number") == F.col("_agent"), "left").where(
        holds(inbound) | F.col("_agent").isNotNull())
    phone = F.when(inbound, F.col("from_number")).otherwise(F.col("to_number"))
    kept = [c for c in calls.columns if c not in ("from_number", "to_number")]
    return rows.withColumn("phone", phone).select("phone", *kept)


def callback_status(calls: DataFrame, total_seconds: bool = False, slice_seconds: int | None = None,
                    heavy_rows: int | None = None) -> DataFrame:
    """When and how each missed call was called back.

    Takes ``prepare_calls`` rows and adds ``callback_status`` and
    ``callback_minutes``. A missed call opens a case unless one is open. The
    next completed inbound call ('inb') or outbound call ('out_success' if
    completed, else 'out_fail') closes it; an outbound missed call closes too.
    A phone whose case stays open has its latest missed call marked
    'no_callback'. Minutes count the part of the wait below one day unless
    ``total_seconds`` is set.

    A call is a map of the two states: it sets closed (completed inbound, answered outbound),
    sets open (missed inbound), or swaps them (missed outbound). Running windows compose the
    maps within a phone. A phone that holds more than its share of the calls (above
    ``heavy_rows``, where given) is cut into slices; each slice is one map of the
    state, with the time of the last opening under either state, and these are composed
    over the phone. With ``slice_seconds`` every phone is cut at those times instead.
    """
    rows = present(calls, "phone", "start_time")
    if slice_seconds is None:
        rows = skew.cut(rows, "phone", [F.col("start_time"), F.col("call_id")], "_slice", floor=heavy_rows)
    else:
        epoch = seconds_between(moment("1970-01-01 00:00:00"), F.col("start_time"))
        rows = rows.withColumn("_slice", F.floor(epoch / F.lit(slice_seconds)).cast("int"))

    inbound, outbound = F.col("direction") == "inbound", F.col("direction") == "outbound"
    missed, completed = holds(F.col("status") == "missed-call"), holds(F.col("status") == "completed")
    fixed = (
        F.when(outbound & ~missed, F.lit(0))
        .when(inbound & completed, F.lit(0))
        .when(missed & ~holds(outbound), F.lit(1)))
    flip = F.when(holds(outbound) & missed, F.lit(1)).otherwise(F.lit(0))

    order = Window.partitionBy("phone", "_slice").orderBy("start_time", "call_id")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The map up to a call is a fixed state or none, and the parity of the swaps since. A fixed
    # state is kept less the swaps before it, so that all swaps of the slice may be added to it.
    # The latest missed call is the first one at the greatest time.
    latest = F.when(missed, F.struct(F.col("start_time"), -F.col("call_id")))
    rows = rows.withColumns({"_flips": F.sum(flip).over(run), "_mark": F.max_by("call_id", latest).over(whole)})
    base = F.when(fixed.isNotNull(), F.pmod(fixed + F.col("_flips"), F.lit(2)))
    rows = rows.withColumns({"_base": F.last(base, ignorenulls=True).over(run),
                             "_base_before": F.last(base, ignorenulls=True).over(earlier)})

    def state(base: str, flips: Column, start: int) -> Column:
        return F.pmod(F.coalesce(base, F.lit(start)) + flips, F.lit(2))

    before = [state("_base_before", F.col("_flips") - flip, s) for s in (0, 1)]
    after = [state("_base", F.col("_flips"), s) for s in (0, 1)]
    opened = [F.last(F.when((before[s] == 0) & (after[s] == 1), F.col("start_time")), ignorenulls=True).over(run) for s in (0, 1)]
    rows = rows.withColumns({"_open0": opened[0], "_open1": opened[1], "_final0": F.last(after[0]).over(whole)})

    carried = _carried(rows.where(F.col("_slice") >= 0), after, missed)
    rows = rows.join(F.broadcast(carried) if slice_seconds is None else carried,
                     (F.col("phone") == F.col("_cp")) & (F.col("_slice") == F.col("_cs")), "left")
    began_open = holds(F.col("_carry") == 1)
    was_open = F.when(began_open, before[1]).otherwise(before[0])
    is_open = F.when(began_open, after[1]).otherwise(after[0])
    opened_at = F.coalesce(F.when(began_open, F.col("_open1")).otherwise(F.col("_open0")), F.col("_carry_open"))
    closes = (was_open == 1) & (is_open == 0)
    unanswered = (F.coalesce("_final", "_final0") == 1) & F.coalesce("_holds_mark", F.lit(True)) & (F.col("call_id") == F.col("_mark"))
    how = F.when(inbound, "inb").when(completed, "out_success").otherwise("out_fail")
    wait = seconds_between(opened_at, F.col("start_time")).cast("double") if total_seconds \
        else clock_seconds(opened_at, F.col("start_time"))
    return rows.select(
        *calls.columns,
        F.when(unanswered, "no_callback").when(closes, how).alias("callback_status"),
        F.when(closes, wait / F.lit(60.0)).alias("callback_minutes"))


def _carried(rows: DataFrame, after: list[Column], missed: Column) -> DataFrame:
    """What each slice of a cut phone starts with, from the composed maps of the slices before it.

    One row per slice. A slice's map says, for either state at its start, the state at its end
    and the last opening in it.
    """
    at = F.struct("start_time", "call_id")
    maps = rows.groupBy("phone", "_slice").agg(
        F.max_by(F.array(*[F.struct(after[s].alias("ends"), F.col(f"_open{s}").alias("opened")) for s in (0, 1)]), at).alias("map"),
        F.bool_or(missed).alias("missed"))
    chain = maps.groupBy("phone").agg(F.sort_array(F.collect_list(F.struct("_slice", "map", "missed"))).alias("chain"))
    when = dict(rows.dtypes)["start_time"]
    start = F.struct(F.lit(0).cast("int").alias("state"), F.lit(None).cast(when).alias("opened"), F.array().cast(
        f"array<struct<slice:int,carry:int,opened:{when}>>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        led = F.get(m["map"], s["state"])
        row = F.struct(m["_slice"].alias("slice"), s["state"].alias("carry"), s["opened"].alias("opened"))
        return F.struct(led["ends"].cast("int").alias("state"), F.coalesce(led["opened"], s["opened"]).alias("opened"),
                        F.concat(s["out"], F.array(row)).alias("out"))

    done = chain.select(
        F.col("phone").alias("_cp"), F.aggregate("chain", start, step).alias("end"),
        F.array_max(F.transform(F.filter("chain", lambda m: m["missed"]), lambda m: m["_slice"])).alias("last_missed"))
    return done.select("_cp", F.col("end.state").alias("_final"), "last_missed", F.inline("end.out")).select(
        "_cp", F.col("slice").alias("_cs"), F.col("carry").alias("_carry"), F.col("opened").alias("_carry_open"), "_final",
        (F.col("slice") == F.col("last_missed")).alias("_holds_mark"))


def callback_kpis(callbacks: DataFrame, period: str = "week") -> DataFrame:
    """Per period: share of missed calls called back within 20 and 60 minutes, not called
    back, and missed calls over inbound calls; percentages."""
    outcome = F.col("callback_status").isNotNull()
    counted = F.col("direction").isNotNull()
    minutes = F.col("callback_minutes")
    sums = present(callbacks, period).groupBy(period).agg(
        F.count_if(outcome & counted).alias("missed"),
        F.count_if(holds(minutes <= 20) & counted).alias("_20"),
        F.count_if(holds(minutes <= 60) & counted).alias("_60"),
        F.count_if(holds(F.col("callback_status") == "no_callback") & counted).alias("_none"),
        F.count_if(holds(F.col("direction") == "inbound")).alias("inbound"))

    def pct(name):
        return ratio(100.0 * null_if_zero(F.col(name)), F.col("missed"))

    return sums.select(
        period, "missed", "inbound",
        F.round(pct("_20"), 1).alias("within_20_pct"),
        F.round(pct("_60"), 1).alias("within_60_pct"),
        ratio(100.0 * null_if_zero(F.col("missed")), F.col("inbound")).alias("missed_pct"),
        F.round(pct("_none"), 1).alias("no_callback_pct"))


def callback_distribution(callbacks: DataFrame, period: str = "week") -> DataFrame:
    """Waiting minutes by outcome and period, for missed calls that were called back."""
    called = callbacks.where(F.col("callback_status").isNotNull() & (F.col("callback_status") != "no_callback"))
    return distribution(called, ["callback_status", period], "callback_minutes")


def handling_time(calls: DataFrame, period: str = "week") -> DataFrame:
    """Handling minutes by direction, status and period, for completed and unsuccessful calls."""
    held = calls.where(F.col("status").isin("unsuccessful", "completed")).withColumn(
        "minutes", F.col("billable_duration") / F.lit(60.0))
    return distribution(held, ["direction", "status", period], "minutes")
