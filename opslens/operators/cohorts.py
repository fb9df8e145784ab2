"""Cohort retention: users, bookings and revenue per cohort month and booking month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import differs, holds, not_in, nps_score, present, to_wide
from ..functions.labels import COMPLETED_STATUSES, COURIER_STATUSES, EXCLUDED_COHORTS
from ..functions.times import month_of
from . import skew
from .bookings import actual_paid
from .nps import nps_summary, share_of_first

METRICS = ["users", "bookings", "revenue"]


def _shares(cells: DataFrame, extra: list[str], cohort: str, month: str) -> DataFrame:
    return cells.select(
        *extra, cohort, month, *METRICS,
        *[share_of_first(m, [*extra, cohort], month).alias(f"{m}_share") for m in METRICS])


def _variant_cells(reduced: DataFrame, conditions: dict[str, Column], keys: list[str]) -> DataFrame:
    """Users, bookings and revenue per variant and cell, from rows of (customer, *keys, flags).

    Each customer's rows of a cell fold into one with the totals of every variant side by side. Customers are
    then counted by adding up, without a distinct, and the variants become rows only once a cell is one row.
    """
    folds = []
    for i, c in enumerate(conditions.values()):
        folds += [F.count_if(c).alias(f"_r{i}"), F.sum(F.when(c, F.col("_bookings"))).alias(f"_b{i}"),
                  F.sum(F.when(c, F.col("_revenue"))).alias(f"_v{i}")]
    folded = reduced.groupBy("phone", *keys).agg(*folds)
    sums = []
    for i in range(len(conditions)):
        sums += [F.sum(f"_r{i}").alias(f"_r{i}"),
                 F.count_if((F.col(f"_r{i}") > 0) & F.col("phone").isNotNull()).alias(f"_u{i}"),
                 F.sum(f"_b{i}").alias(f"_b{i}"), F.sum(f"_v{i}").alias(f"_v{i}")]
    cells = present(folded, *keys).groupBy(*keys).agg(*sums)
    listed = F.array(*[
        F.struct(F.lit(name).alias("variant"), F.col(f"_r{i}").alias("rows"), F.col(f"_u{i}").alias("users"),
                 F.col(f"_b{i}").alias("bookings"), F.coalesce(f"_v{i}", F.lit(0.0)).alias("revenue"))
        for i, name in enumerate(conditions)])
    return cells.select(*keys, F.inline(F.filter(listed, lambda v: v["rows"] > 0))).drop("rows")


def _measures(revenue: str) -> list[Column]:
    return [F.count("booking_id").alias("_bookings"), F.sum(revenue).alias("_revenue")]


def cohort_matrix(bookings: DataFrame, cohort: str = "cohort_group", month: str = "booking_month",
                  revenue: str = "total_revenue") -> DataFrame:
    """Distinct users, bookings and revenue per (cohort, month), and each over the
    cohort's first month present."""
    return matrix_of(bookings, _measures(revenue), cohort, month)


def matrix_of(rows: DataFrame, measures: list[Column], cohort: str = "cohort_group",
              month: str = "booking_month") -> DataFrame:
    """The cohort matrix; ``measures`` fold a customer's rows of a cell into _bookings and _revenue."""
    per_customer = present(rows, cohort, month).groupBy("phone", cohort, month).agg(*measures)
    # One row per customer and cell, so counting customers needs no distinct.
    cells = per_customer.groupBy(cohort, month).agg(
        F.count("phone").alias("users"), F.sum("_bookings").alias("bookings"),
        F.coalesce(F.sum("_revenue"), F.lit(0.0)).alias("revenue"))
    return _shares(cells, [], cohort, month)


def cohort_wide(matrix: DataFrame, metric: str, months: list[str], cohort: str = "cohort_group",
                month: str = "booking_month", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per cohort, one column per listed month."""
    return to_wide(matrix, [*extra, cohort], month, months, metric)


def cohort_variants(bookings: DataFrame, city: str | None = None,
                    excluded: list[str] = EXCLUDED_COHORTS) -> DataFrame:
    """The cohort matrix for all customers and four customer selections, in one pass.

    The bookings are first reduced to one row per customer, cohort, month and
    selection flag, so the per-customer average feedback is taken over a group
    no longer than the calendar, however many bookings a customer has.
    """
    rows = bookings if city is None else bookings.where(F.col("city") == city)
    return variants_of(rows.withColumns(selections()), [
        *_measures("total_revenue"), F.sum("feedback").alias("_fs"), F.count("feedback").alias("_fn")], excluded)


def selections() -> dict[str, Column]:
    """The flags of one enriched booking by which customers are selected."""
    return {"_garbage": holds((F.col("successful_bookings") == 1) & (F.col("amp") == 0)),
            "_repeat": holds(F.col("successful_bookings") > 1), "_good": holds(F.col("rating") > 3)}


def variants_of(rows: DataFrame, measures: list[Column], excluded: list[str]) -> DataFrame:
    """The report of ``cohort_variants`` from rows with ``selections``; ``measures`` fold them into
    _bookings, _revenue, _fs and _fn."""
    rows = rows.where(not_in(F.col("cohort_group"), excluded))
    reduced = rows.groupBy("phone", "cohort_group", "booking_month", *selections()).agg(*measures)
    customer = Window.partitionBy("phone")
    feedback = F.try_divide(F.sum("_fs").over(customer), F.sum("_fn").over(customer))
    reduced = reduced.withColumn("_liked", holds(F.col("phone").isNotNull() & (feedback >= 3)))
    cells = _variant_cells(
        reduced,
        {"Overall": F.lit(True), "wo_garbage": ~F.col("_garbage"), "atleast_2_bookings": F.col("_repeat"),
         "avg_feedback>=3": F.col("_liked"), "profile=4,5": F.col("_good")},
        ["cohort_group", "booking_month"])
    return _shares(cells, ["variant"], "cohort_group", "booking_month")


def cohorts_for_good_localities(bookings: DataFrame, min_size: int = 5, min_nps: float = 0.10,
                                excluded_month: str | None = "2016-06",
                                heavy_rows: int | None = None) -> DataFrame:
    """Cohorts of the customers in well-rated localities, from a raw dump.

    Cohort month, booking count and so on are taken within the selected rows.
    """
    scored = bookings.withColumn("nps", nps_score(F.col("feedback")))
    good = nps_summary(scored, ["locality"], COMPLETED_STATUSES, min_size, min_nps).select(
        "locality", F.col("size").alias("n_rows"), F.lit(True).alias("_chosen"))
    rows = skew.attach(
        bookings.where(F.col("status").isin(COURIER_STATUSES)), good, "locality", F.col("booking_id"),
        floor=heavy_rows,
    ).where(F.col("_chosen")).withColumn("booking_month", month_of(F.col("requested_date")))
    if excluded_month is not None:
        rows = rows.where(differs(F.col("booking_month"), excluded_month))
    reduced = (
        rows.withColumn("_free", holds(actual_paid() == 0))
        .withColumn("_good", holds(F.col("rating") > 3))
        .groupBy("phone", "booking_month", "_free", "_good")
        .agg(*_measures("amount"), F.count("requested_date").alias("_dated"))
    )
    customer = Window.partitionBy("phone")
    reduced = present(
        reduced.withColumn("cohort_month", F.min("booking_month").over(customer))
        .withColumn("_n", F.sum("_dated").over(customer)), "phone")
    cells = _variant_cells(
        reduced,
        {"Overall": F.lit(True), "wo_garbage": ~((F.col("_n") == 1) & F.col("_free")),
         "atleast_2_bookings": F.col("_n") > 1, "profile=4,5": F.col("_good")},
        ["cohort_month", "booking_month"])
    return _shares(cells, ["variant"], "cohort_month", "booking_month")
