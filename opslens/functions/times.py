"""Timestamps without zone: differences, periods and slot labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Period = tuple[str, "str | dt.date", "str | dt.date"]

def moment(value) -> Column:
    """A zone-free timestamp literal from a date, a datetime or ISO text."""
    return F.lit(str(value)).cast("timestamp_ntz")


def hours(n: float) -> Column:
    return F.lit(dt.timedelta(hours=n))


def days(n: int) -> Column:
    return F.lit(dt.timedelta(days=n))


def seconds_between(start: Column, end: Column) -> Column:
    """``end - start`` in seconds with microsecond digits, zone-independent."""
    return (end - start).cast(T.DayTimeIntervalType(3, 3)).cast("decimal(20,6)")


def whole_days_between(start: Column, end: Column) -> Column:
    """Days of difference, floored."""
    return F.floor(seconds_between(start, end) / F.lit(86400)).cast("long")


def clock_seconds(start: Column, end: Column) -> Column:
    """The whole seconds of ``end - start`` left after taking out full days."""
    return F.pmod(F.floor(seconds_between(start, end)).cast("long"), F.lit(86400).cast("long"))


def read_time(col: Column, pattern: str | None = None) -> Column:
    """Lenient text to timestamp; give a pattern for day-first text."""
    if pattern is None:
        return F.trim(col).try_cast("timestamp_ntz")
    return F.try_to_timestamp(F.trim(col), F.lit(pattern)).cast("timestamp_ntz")


def month_of(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


def day_of(col: Column) -> Column:
    return F.date_format(col, "dd")


def in_period(col: Column, start, end, end_days: int = 1) -> Column:
    """``start <= col <= end + end_days``, both ends included."""
    return (col >= moment(start)) & (col <= moment(end) + days(end_days))


def period_label(col: Column, periods: list[Period], default: str | None = None, end_days: int = 1) -> Column:
    """Label of the first period that contains ``col``.

    Dates outside every period and missing dates take ``default``; without one
    they take the label of the last period.
    """
    if default is None:
        *periods, last = periods
        default = last[0]
    if not periods:
        return F.lit(default)
    (name, start, end), *rest = periods
    label = F.when(in_period(col, start, end, end_days), F.lit(name))
    for name, start, end in rest:
        label = label.when(in_period(col, start, end, end_days), F.lit(name))
    return label.otherwise(F.lit(default))


def weekly_periods(start: dt.date, count: int, first: int = 1, length: int = 7) -> list[Period]:
    """``count`` back-to-back periods labelled W1, W2, ..."""
    out = []
    for i in range(count):
        lo = start + dt.timedelta(days=length * i)
        out.append((f"W{first + i}", lo, lo + dt.timedelta(days=length - 1)))
    return out


def step_week_names(start: dt.date, count: int = 4) -> list[str]:
    """Names of consecutive seven-day steps, like 'Aug-08 to Aug-14'."""
    firsts = [start + dt.timedelta(days=7 * i) for i in range(count)]
    return [f"{lo:%b-%d} to {lo + dt.timedelta(days=6):%b-%d}" for lo in firsts]


def step_week_label(col: Column, start: dt.date, count: int = 4) -> Column:
    """Half-open seven-day steps; earlier dates fall into the first, later and missing ones into the last."""
    names = step_week_names(start, count)
    label = F.lit(names[-1])
    for i in reversed(range(count - 1)):
        label = F.when(col < moment(start + dt.timedelta(days=7 * (i + 1))), F.lit(names[i])).otherwise(label)
    return label


def iso_week_label(col: Column) -> Column:
    return F.concat(F.lit("W"), F.weekofyear(col).cast("string"))


def slot_start(day: Column, hour: Column) -> Column:
    """Timestamp at which a slot opens, from a date (or its text) and an hour text; null if unreadable."""
    opens = F.trim(hour).try_cast("int")
    return F.when(
        opens.between(0, 23),
        day.try_cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), opens))


def slot_label(at: Column, start: Column, steps: list[tuple[float, str]], later: str) -> Column:
    """First step whose end (hours after the slot start, inclusive) ``at`` does not pass.

    A missing time or slot falls through to ``later``.
    """
    late_by = at - start
    label = F.lit(later)
    for limit, name in reversed(steps):
        label = F.when(late_by <= hours(limit), F.lit(name)).otherwise(label)
    return label
