"""Delivery visits: out-for-delivery assignment and the delivery funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import holds, present, with_reason_rank
from ..functions.labels import (
    CANCELLED_LATER, CANCELLED_STEPS, DELIVERY_LATER, DELIVERY_REASON_RULES, DELIVERY_STEPS, HOURLY_DELIVERY_LATER,
    HOURLY_DELIVERY_STEPS,
)
from ..functions.text import list_items, list_length, normalise_reason, range_start
from ..functions.times import in_period, read_time, slot_label, slot_start, step_week_label, step_week_names
from . import skew

# Visits of one booking that are held in one value at most, about.
SLICE_VISITS = 100_000

DELIVERY_SLOTS = [name for _, name in DELIVERY_STEPS] + [DELIVERY_LATER]
HOURLY_SLOTS = [name for _, name in HOURLY_DELIVERY_STEPS] + [HOURLY_DELIVERY_LATER]


def _visit_facts() -> list[Column]:
    """What a booking's stamps follow from; facts of slices add up to those of the booking."""
    return [
        F.bool_or(holds(F.col("visit_status") == "done")).alias("done"),
        F.min(F.when(F.col("ofd_happened_at").isNotNull(), F.struct("visit_id", "ofd_happened_at"))).alias("listed"),
        F.max("creation_time").alias("created"),
        F.max(list_length(F.col("ofd_happened_at"))).alias("attempts")]


def _stamps(done: Column, listed: Column, created: Column, attempts: Column, pattern: str | None) -> Column:
    """A booking's made-up stamp list, number of attempts, last stamp and the stamps before it.

    Without any stamp a booking with a done visit gets its latest creation time
    as the only stamp; without either it gets none.
    """
    made_up = F.when(listed.isNull() & done, F.date_format(created, "yyyy-MM-dd HH:mm:ss"))
    times = F.transform(list_items(F.coalesce(listed["ofd_happened_at"], made_up)), lambda s: read_time(s, pattern))
    return F.struct(
        made_up.alias("made_up"), F.coalesce(attempts, F.when(made_up.isNotNull(), F.lit(1))).alias("attempts"),
        F.element_at(times, -1).alias("last"), F.slice(times, F.lit(1), F.greatest(F.size(times) - 1, F.lit(0))).alias("queue"))


def _due(queue: Column, place: Column, cancelled: Column) -> Column:
    return holds(cancelled >= F.get(queue, place))


def _start_places(slices: DataFrame, pattern: str | None) -> DataFrame:
    """Stamps of each cut booking and the place in them that each of its slices starts with; one row per slice.

    A slice is a map from every place it may start with to the place it then ends with: that is
    the work over its visits, done slice by slice. The maps of a booking are then composed.
    """
    facts = slices.groupBy("booking_id").agg(
        F.bool_or("done").alias("done"), F.min("listed").alias("listed"), F.max("created").alias("created"),
        F.max("attempts").alias("attempts"))
    facts = facts.select(F.col("booking_id").alias("_fb"), _stamps(
        *[F.col(c) for c in ("done", "listed", "created", "attempts")], pattern).alias("stamps"))
    queue = F.col("stamps")["queue"]
    leads = F.transform(F.sequence(F.lit(0), F.greatest(F.size(queue), F.lit(0))), lambda start: F.aggregate(
        "visits", start, lambda p, v: F.when(_due(queue, p, v["cancelled"]), p + 1).otherwise(p)))
    maps = slices.join(facts, F.col("booking_id") == F.col("_fb")).select("booking_id", "_slice", "stamps", leads.alias("to"))
    chain = maps.groupBy("booking_id").agg(
        F.any_value("stamps").alias("stamps"), F.sort_array(F.collect_list(F.struct("_slice", "to"))).alias("chain"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<slice:int,start:int>>").alias("out"))
    composed = F.aggregate("chain", begin, lambda s, m: F.struct(
        F.get(m["to"], s["at"]).alias("at"),
        F.concat(s["out"], F.array(F.struct(m["_slice"].alias("slice"), s["at"].alias("start")))).alias("out")))
    return chain.select(F.col("booking_id").alias("_b"), "stamps", F.inline(composed["out"])).select(
        "_b", F.col("slice").alias("_s"), "stamps", "start")


def assign_ofd(visits: DataFrame, pattern: str | None = None, heavy_rows: int | None = None,
               heavy_visits: int | None = None, slice_ids: int | None = None) -> DataFrame:
    """Give out-for-delivery stamps to visits; adds ``ofd_time`` and ``ofd_attempts``.

    Done visits take the booking's last stamp, which is used up even without a
    done visit. The others go greedily to visits in visit order, and may
    overwrite a done visit's: a visit cancelled at or after the next stamp takes it, one
    stamp per visit. A visit id listed twice in a booking is two visits,
    in the order of cancellation time and then of the remaining columns.

    A booking's visits meet in one row, once, and are matched there; they are dealt before they are
    gathered, so no task sorts what it has read. A booking that holds more than
    its share of the visits (above ``heavy_rows`` or ``heavy_visits``, where given) is cut into
    slices of ``slice_ids`` visits, about; see ``_start_places``.
    """
    names = visits.columns
    floor = heavy_rows if heavy_visits is None else heavy_visits if heavy_rows is None else min(heavy_rows, heavy_visits)
    rest = [c for c in names if c not in ("booking_id", "visit_id", "cancellation_time")]
    visits = present(visits, "booking_id")
    order = [F.col("visit_id"), F.col("cancellation_time").isNull(), F.col("cancellation_time")]
    stats = skew.key_counts(visits, "booking_id")
    some = skew.any_oversized(stats, floor=floor, most=SLICE_VISITS)
    rows = skew.cut(visits, "booking_id", order, "_slice", stats, floor=floor, slice_rows=slice_ids, most=SLICE_VISITS, some=some)
    row = [F.col("visit_id").alias("visit"), F.col("cancellation_time").isNull().alias("open"),
           F.col("cancellation_time").alias("cancelled")]

    def gathered(columns: list[Column]) -> Column:
        return F.sort_array(F.collect_list(F.struct(*columns))).alias("visits")

    # equal times take a stamp alike, so the maps need no other column
    begun = _start_places(rows.where(some & (F.col("_slice") >= 0)).groupBy("booking_id", "_slice").agg(
        gathered(row), *_visit_facts()), pattern)
    met = rows.repartition("booking_id", "_slice").groupBy("booking_id", "_slice").agg(
        gathered([*row, F.struct(*rest).alias("rest")]), *_visit_facts()).join(
        F.broadcast(begun), (F.col("booking_id") == F.col("_b")) & (F.col("_slice") == F.col("_s")), "left")
    met = met.withColumn("_stamps", F.coalesce("stamps", _stamps(*[F.col(c) for c in ("done", "listed", "created", "attempts")], pattern)))
    queue, start = F.col("_stamps")["queue"], F.coalesce("start", F.lit(0))
    # places of the visits that take a stamp, in stamp order
    none = F.struct(F.lit(0).alias("i"), start.alias("at"), F.array().cast("array<int>").alias("took"))
    took = F.aggregate("visits", none, lambda s, v: F.struct(
        (s["i"] + 1).alias("i"), (s["at"] + _due(queue, s["at"], v["cancelled"]).cast("int")).alias("at"),
        F.when(_due(queue, s["at"], v["cancelled"]), F.concat(s["took"], F.array(s["i"]))).otherwise(s["took"]).alias("took")))
    taken = F.when(F.size(queue) > 0, took["took"]).otherwise(F.array().cast("array<int>"))
    met = met.select("booking_id", "_stamps", queue.alias("_queue"), start.alias("_start"), taken.alias("_took"), "visits")
    # a select of its own: beside the generator, all of that would be worked out again for every visit, on a copy of the list
    out = met.select("booking_id", "_stamps", "_queue", "_start", "_took", F.posexplode("visits").alias("_i", "_v"))
    nth = F.array_position("_took", F.col("_i")).cast("int")
    own = F.when(nth > 0, F.get("_queue", F.col("_start") + nth - 1))
    stamp = F.coalesce(own, F.when(F.col("_v.rest.visit_status") == "done", F.col("_stamps.last")))
    source = {"booking_id": F.col("booking_id"), "visit_id": F.col("_v.visit"), "cancellation_time": F.col("_v.cancelled"),
              "ofd_happened_at": F.coalesce("_v.rest.ofd_happened_at", "_stamps.made_up")}
    return out.select(*[source.get(c, F.col("_v.rest")[c]).alias(c) for c in names], stamp.alias("ofd_time"),
                      F.col("_stamps.attempts").alias("ofd_attempts"))


def with_delivery_slots(visits: DataFrame) -> DataFrame:
    """Merge update and cancellation time and label update, out-for-delivery and creation against the slot."""
    v = visits.withColumn(
        "updation_time",
        F.when(F.col("visit_status") == "done", F.col("updation_time")).otherwise(F.col("cancellation_time")),
    ).withColumn("requested_datetime", slot_start(F.col("requested_date"), range_start(F.col("requested_time"))))

    def label(at):
        return slot_label(F.col(at), F.col("requested_datetime"), DELIVERY_STEPS, DELIVERY_LATER)

    return v.withColumns({
        "updation_slot": label("updation_time"),
        "ofd_slot": label("ofd_time"),
        "creation_slot": label("creation_time"),
    })


# What a visit can be counted under while the funnels are summed. Visits:
_WON_OUT, _WON_IN, _LOST_OUT, _LOST_IN, _REST = 1, 2, 3, 4, 5
# Cancel reasons, numbered as the report's sections:
_REASON_OUT, _REASON_IN = 6, 7
# Out-for-delivery attempts of the first version:
_ATTEMPTS = 8
# Bookings delivered at the first attempt, or later: all, without slot, by slot.
_SINGLE, _SINGLE_BLANK, _SINGLE_SLOT, _MULTIPLE, _MULTIPLE_BLANK, _MULTIPLE_SLOT = 9, 10, 11, 12, 13, 14
_DELIVERED = 15


def _entry(section: Column, label: Column, n: Column | None = None, booking: bool = False) -> Column:
    """One thing a visit counts under; a booking is counted once however many visits name it."""
    return F.when(section.isNotNull(), F.struct(
        section.alias("section"), label.cast("string").alias("label"),
        (F.col("booking_id") if booking else F.lit(None).cast("bigint")).alias("booking"),
        (F.lit(1) if n is None else n).cast("bigint").alias("n")))


def _attempt_entries() -> list[Column]:
    done, attempts = F.col("visit_status") == "done", F.col("ofd_attempts")
    blank = F.col("requested_date").isNull()
    kind = F.when(done & (attempts == 1), F.lit(_SINGLE)).when(done & (attempts > 1), F.lit(_MULTIPLE))
    return [
        _entry(kind, F.lit(None), booking=True),
        _entry(kind + F.when(blank, 1).otherwise(2), F.when(~blank, F.col("updation_slot")), booking=True),
    ]


def _counted(visits: DataFrame, entries: list[Column]) -> DataFrame:
    """Visits and distinct bookings per week, section and label, in one pass over the visits.

    Plain counts collapse map-side; bookings to be counted once are shuffled by
    week, section, label and booking, so no week gathers in one task.
    """
    added = visits.select("week", F.inline(F.array(*entries))).where(F.col("section").isNotNull())
    return added.groupBy("week", "section", "label").agg(
        F.sum("n").alias("n"), F.count_distinct("booking").alias("bookings"))


def _lines(counted: DataFrame, weeks: list[str], entries: list[Column], labels: list[tuple[int, str]]) -> DataFrame:
    """Turn the counts into report lines; ``labels`` are shown, as null, even without a count.

    Runs on one row per week and label.
    """
    blank = counted.sparkSession.createDataFrame(
        [(w, o, m) for w in weeks for o, m in labels], "week string, ord int, metric string"
    ).withColumn("value", F.lit(None).cast("double"))
    lines = counted.select("week", F.inline(F.array(*entries))).where(F.col("ord").isNotNull())
    return lines.unionByName(blank).groupBy("week", "ord", "metric").agg(F.sum("value").alias("value")).withColumn(
        "_visits", F.max(F.when(F.col("ord") == 1, F.col("value"))).over(Window.partitionBy("week"))
    ).where(F.col("_visits") > 0).drop("_visits")


def _line(sections: list[int], ord_: Column | int, metric: Column | str, value: Column) -> Column:
    return F.when(F.col("section").isin(sections), F.struct(
        (ord_ if isinstance(ord_, Column) else F.lit(ord_)).alias("ord"),
        (F.lit(metric) if isinstance(metric, str) else metric).alias("metric"),
        value.cast("double").alias("value")))


def _attempt_lines(first: int, slots: list[str]) -> tuple[list[Column], list[tuple[int, str]]]:
    shift = first - _SINGLE
    label = F.coalesce(
        F.col("label"),
        F.when(F.col("section") == _SINGLE, "single_ofd").when(F.col("section") == _MULTIPLE, "multiple_ofd")
        .when(F.col("section") == _SINGLE_BLANK, "without_slot").otherwise("without_slot_mulOFD"))
    lines = [
        _line([*range(_SINGLE, _MULTIPLE_SLOT + 1)], F.col("section") + shift, label, F.col("bookings")),
        _line([_SINGLE, _MULTIPLE], _DELIVERED + shift, "total_bookings", F.col("bookings")),
    ]
    return lines, [(section + shift, s) for section in (_SINGLE_SLOT, _MULTIPLE_SLOT) for s in slots]


def _zeros(first: int) -> list[tuple[int, str]]:
    shift = first - _SINGLE
    return [(_SINGLE + shift, "single_ofd"), (_SINGLE_BLANK + shift, "without_slot"),
            (_MULTIPLE + shift, "multiple_ofd"), (_MULTIPLE_BLANK + shift, "without_slot_mulOFD"),
            (_DELIVERED + shift, "total_bookings")]


def _zero_filled(lines: DataFrame, zeros: list[tuple[int, str]]) -> DataFrame:
    """Lines that count something are 0, not absent, when there is nothing to count."""
    counting = F.array(*[F.concat_ws("/", F.lit(str(o)), F.lit(m)) for o, m in zeros])
    listed = F.array_contains(counting, F.concat_ws("/", F.col("ord").cast("string"), F.col("metric")))
    return lines.withColumn("value", F.when(listed, F.coalesce("value", F.lit(0.0))).otherwise(F.col("value")))


def delivery_funnel(visits: DataFrame, start, end, week_start, weeks: int = 4, city: str | None = None,
                    pattern: str | None = None, **limits: int) -> DataFrame:
    """Per week: visits, out-for-delivery outcome, cancel reasons, slots and attempts.

    Visits created from ``start`` to ``end`` (plus a day) that are done or
    cancelled, in seven-day steps from ``week_start``. Rows are
    ``(week, ord, metric, value, rank)``; the labels of one section share ``ord``, and
    ``rank`` orders cancel reasons by falling count.
    """
    v = visits.where(in_period(F.col("creation_time"), start, end)
                     & F.col("visit_status").isin("done", "cancelled"))
    if city is not None:
        v = v.where(F.col("city") == city)
    v = with_delivery_slots(assign_ofd(v, pattern, **limits))
    v = v.withColumn("week", step_week_label(F.col("creation_time"), week_start, weeks))
    out_for, lost = F.col("ofd_time").isNotNull(), F.col("visit_status") == "cancelled"
    reason = F.when(lost, normalise_reason(F.col("visit_cancel_reason"), DELIVERY_REASON_RULES))
    v = v.withColumn("out_for", out_for).withColumn("reason", reason)
    out_for = F.col("out_for")
    counted = _counted(v, [
        _entry(F.when(lost, F.when(out_for, _LOST_OUT).otherwise(_LOST_IN)).otherwise(
            F.when(out_for, _WON_OUT).otherwise(_WON_IN)), F.when(lost & out_for, F.col("updation_slot"))),
        _entry(F.when(F.col("reason").isNotNull(), F.when(out_for, _REASON_OUT).otherwise(_REASON_IN)),
               F.col("reason")),
        *_attempt_entries(),
    ])
    n = F.col("n")
    attempt_lines, attempt_labels = _attempt_lines(9, DELIVERY_SLOTS)
    zeros = [(2, "ofd_visits"), (3, "not_ofd_visits"), (4, "successful_deliveries"), (5, "ofd_unsuccessful"), *_zeros(9)]
    lines = _lines(counted, step_week_names(week_start, weeks), [
        _line([_WON_OUT, _WON_IN, _LOST_OUT, _LOST_IN], 1, "total_visits", n),
        _line([_WON_OUT, _LOST_OUT], 2, "ofd_visits", n),
        _line([_WON_IN, _LOST_IN], 3, "not_ofd_visits", n),
        _line([_WON_OUT, _WON_IN], 4, "successful_deliveries", n),
        # Out-for-delivery visits less deliveries: lost ones count up, deliveries without stamp count down.
        _line([_LOST_OUT, _WON_IN], 5, "ofd_unsuccessful", F.when(F.col("section") == _LOST_OUT, n).otherwise(-n)),
        _line([_REASON_OUT, _REASON_IN], F.col("section"), F.col("label"), n),
        _line([_LOST_OUT], 8, F.col("label"), n),
        *attempt_lines,
    ], [(8, s) for s in DELIVERY_SLOTS] + attempt_labels + zeros)
    return with_reason_rank(_zero_filled(lines, zeros), ["week", "ord"], [_REASON_OUT, _REASON_IN])


def hourly_visit_slot(visits: DataFrame) -> DataFrame:
    """The first version's labels: hourly steps for done visits, coarser ones for cancelled visits."""
    v = visits.withColumn(
        "requested_datetime", slot_start(F.col("requested_date"), range_start(F.col("requested_time"))))
    at = F.col("requested_datetime")
    return v.withColumn(
        "updation_slot",
        F.when(F.col("visit_status") == "done",
               slot_label(F.col("updation_time"), at, HOURLY_DELIVERY_STEPS, HOURLY_DELIVERY_LATER))
        .when(F.col("visit_status") == "cancelled",
              slot_label(F.col("cancellation_time"), at, CANCELLED_STEPS, CANCELLED_LATER)))


def delivery_funnel_v1(visits: DataFrame, start, end, city: str | None = None,
                       heavy_rows: int | None = None) -> DataFrame:
    """The first version of the delivery funnel: attempts come from the stamp lists alone.

    A booking's attempts are taken over all of its visits, before the period filter.
    """
    attempts = skew.built_once(present(visits, "booking_id").groupBy("booking_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(list_length(F.col("ofd_happened_at"))).alias("ofd_attempts")))
    v = visits.where(in_period(F.col("creation_time"), start, end))
    if city is not None:
        v = v.where(F.col("city") == city)
    v = hourly_visit_slot(skew.attach(v, attempts, "booking_id", F.col("visit_id"), floor=heavy_rows))
    done = F.col("visit_status") == "done"
    counted = _counted(v.withColumn("week", F.lit("all")), [
        _entry(F.when(done, _WON_OUT).otherwise(_REST), F.lit(None)),
        _entry(F.when(done, _ATTEMPTS), F.lit(None), F.coalesce("ofd_attempts", F.lit(0))),
        _entry(F.when(done, _DELIVERED), F.lit(None), booking=True),
        *_attempt_entries(),
    ])
    n, won = F.col("n"), F.col("bookings")
    attempt_lines, attempt_labels = _attempt_lines(6, HOURLY_SLOTS)
    zeros = [(2, "ofd_visits"), (3, "not_ofd_visits"), (4, "successful_deliveries"), (5, "ofd_unsuccessful"), *_zeros(6)]
    lines = _lines(counted, ["all"], [
        _line([_WON_OUT, _REST], 1, "total_visits", n),
        _line([_ATTEMPTS], 2, "ofd_visits", n),
        _line([_WON_OUT, _REST, _ATTEMPTS], 3, "not_ofd_visits",
              F.when(F.col("section") == _ATTEMPTS, -n).otherwise(n)),
        _line([_DELIVERED], 4, "successful_deliveries", won),
        _line([_ATTEMPTS, _DELIVERED], 5, "ofd_unsuccessful",
              F.when(F.col("section") == _ATTEMPTS, n).otherwise(-won)),
        *attempt_lines,
    ], attempt_labels + zeros)
    return _zero_filled(lines, zeros).drop("week")
