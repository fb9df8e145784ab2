"""Booking merge, revenue columns and per-customer enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import holds, nps_score, or_zero, positive_or_zero, present
from ..functions.labels import REVENUE_BANDS, SUCCESS_STATUSES
from ..functions.times import month_of
from . import skew


def merge_bookings(newer: DataFrame, older: DataFrame, key: str = "booking_id") -> DataFrame:
    """Union of two dumps by booking: the newer cell wins, the older one fills its gaps.

    Keeps the newer dump's columns in their order.
    """
    shared = [c for c in newer.columns if c != key]
    n, o = newer.alias("n"), older.alias("o")
    merged = []
    for c in shared:
        cell = F.col(f"n.{c}")
        merged.append((F.coalesce(cell, F.col(f"o.{c}")) if c in older.columns else cell).alias(c))
    joined = n.join(o, F.col(f"n.{key}") == F.col(f"o.{key}"), "full_outer")
    both = joined.select(F.coalesce(F.col(f"n.{key}"), F.col(f"o.{key}")).alias(key), *merged)
    return both.select(*newer.columns)


def merge_dumps(dumps: list[DataFrame], key: str = "booking_id") -> DataFrame:
    """Any number of dumps, newest first, as one: of each cell the newest one that is not null.

    Keeps the first dump's columns in their order; a column that another dump lacks is null there.
    The dumps are stacked and folded in one aggregate, so there is one shuffle however many
    there are, and a booking's rows are folded before it. Rows without key stay rows of their own.
    """
    first = dumps[0]
    stacked = None
    for age, dump in enumerate(dumps):
        part = dump.select(*[F.col(c) if c in dump.columns else F.lit(None).cast(t).alias(c) for c, t in first.dtypes],
                           F.lit(age).alias("_age"))
        stacked = part if stacked is None else stacked.unionByName(part)
    cells = [c for c in first.columns if c != key]
    merged = present(stacked, key).groupBy(key).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_age"))).alias(c) for c in cells])
    return merged.unionByName(stacked.where(F.col(key).isNull()).drop("_age")).select(*first.columns)


def with_revenue(bookings: DataFrame) -> DataFrame:
    """Booking month, gap-filled money columns, total revenue and the amount actually paid."""
    return (
        bookings.withColumn("booking_month", month_of(F.col("requested_date")))
        .withColumn("discount_amount", or_zero(F.col("discount_amount")))
        .withColumn("taxes", or_zero(F.col("taxes")))
        .withColumn("credits_used", positive_or_zero(F.col("credits_used")))
        .withColumn("total_revenue", F.col("amount") + F.col("taxes"))
        .withColumn("amp", F.col("total_revenue") - F.col("discount_amount") - F.col("credits_used"))
    )


def actual_paid() -> Column:
    """The variant without taxes: amount less discount and credits."""
    return F.col("amount") - or_zero(F.col("discount_amount")) - positive_or_zero(F.col("credits_used"))


# --- per-customer facts, each from aggregates over the customer's bookings ---

def _by_date() -> Column:
    """Order of a customer's dated bookings; earliest date first, then booking id."""
    return F.when(F.col("requested_date").isNotNull(), F.struct("requested_date", "booking_id"))


def _first_booking(col: str) -> Column:
    return F.min_by(F.col(col), _by_date())


def _acquisition_label(referred: Column, coupon: Column) -> Column:
    return (
        F.when((referred == 1) & coupon.isNotNull(), "Both Marketing & Referral")
        .when(referred == 1, "Only Referral")
        .when(coupon.isNotNull(), "Only Marketing")
        .otherwise("Organically")
    )


def _acquisition_facts() -> list[Column]:
    return [F.min_by(F.struct("referred", "coupon"), _by_date()).alias("_first_offer")]


def _acquisition() -> Column:
    return _acquisition_label(F.col("_first_offer.referred"), F.col("_first_offer.coupon"))


def _segment_facts() -> list[Column]:
    premium = holds(F.col("category") == "Laundry")
    regular = holds(F.col("category") == "Regular Laundry")
    return [
        F.bool_and(premium).alias("_all_premium"),
        F.bool_and(regular).alias("_all_regular"),
        F.bool_and(F.col("type").contains("Dry")).alias("_all_dry"),
        F.sum(F.when(premium, F.col("amount"))).alias("_premium_gmv"),
        F.sum(F.when(regular, F.col("amount"))).alias("_regular_gmv"),
        F.sum(F.when(F.col("category").isNotNull(), F.col("amount"))).alias("_gmv"),
    ]


def _segment(threshold: float) -> Column:
    premium_share = F.try_divide(F.coalesce("_premium_gmv", F.lit(0.0)), F.col("_gmv"))
    regular_share = F.try_divide(F.coalesce("_regular_gmv", F.lit(0.0)), F.col("_gmv"))
    return (
        F.when(F.col("_all_premium"), "only premium")
        .when(F.col("_all_regular"), "only regular")
        .when(premium_share < threshold, "only regular")
        .when(regular_share < threshold, "only premium")
        .otherwise("both premium & regular")
    )


def _only_dc() -> Column:
    return F.when(F.col("_all_premium") & F.coalesce(F.col("_all_dry"), F.lit(True)), F.lit(1))


def _rating_facts() -> list[Column]:
    return [F.count("requested_date").alias("successful_bookings"), F.sum("amp").alias("_amp")]


def _rating() -> Column:
    revenue = F.try_divide(F.coalesce("_amp", F.lit(0.0)), F.col("successful_bookings"))
    spend = F.lit(5)
    for bound, score in reversed(REVENUE_BANDS):
        spend = F.when(revenue <= bound, F.lit(score)).otherwise(spend)
    times = F.when(F.col("successful_bookings").between(1, 4), F.col("successful_bookings")).otherwise(F.lit(5))
    return F.lit(0.5) * (spend + times)


def _credits_facts() -> list[Column]:
    # On equal dates the lowest booking id counts as the latest.
    latest = F.when(F.col("requested_date").isNotNull(), F.struct("requested_date", -F.col("booking_id")))
    return [F.max_by("customer_credits", latest).alias("_latest_credits")]


def _per_customer(bookings: DataFrame, facts: list[Column], **columns: Column) -> DataFrame:
    stats = present(bookings, "phone").groupBy("phone").agg(*facts)
    return stats.select("phone", *[c.alias(name) for name, c in columns.items()])


def acquisition_source(bookings: DataFrame) -> DataFrame:
    """How each customer's first booking came about: referral, coupon, both or neither."""
    return _per_customer(bookings, _acquisition_facts(), acquisition_source=_acquisition())


def customer_segment(bookings: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Premium / regular / both, by what each customer spends; ``only_dc`` marks dry-cleaning-only premium."""
    return _per_customer(bookings, _segment_facts(), customer_segment=_segment(threshold), only_dc=_only_dc())


def customer_rating(bookings: DataFrame) -> DataFrame:
    """Half of a spend score plus half of a frequency score, each 1 to 5."""
    return _per_customer(bookings, _rating_facts(), successful_bookings=F.col("successful_bookings"),
                         rating=_rating())


def latest_credits(bookings: DataFrame) -> DataFrame:
    """The credit balance written on each customer's latest booking."""
    return _per_customer(bookings, _credits_facts(), customer_credits=F.col("_latest_credits"))


def duplicate_flag(bookings: DataFrame, known: DataFrame | None = None,
                   heavy_rows: int | None = None) -> DataFrame:
    """Mark a booking 1 when its parent is a booking of the same customer and it was not a redo.

    Parents are looked for in ``known``, by default the bookings themselves;
    a ``booking_id`` that is listed twice there counts once. Bookings that name
    no parent, or one that very many others name, are spread over the shuffle.
    """
    parents = present(bookings if known is None else known, "phone", "booking_id").groupBy(
        F.col("booking_id").alias("_parent")).agg(F.collect_set("phone").alias("_parent_phones"))
    asking = bookings.withColumn("_parent", F.when(F.col("rescheduled_redo").isNull(), F.col("parent_id")))
    found = skew.lookup(asking, parents, "_parent", F.col("booking_id"), floor=heavy_rows)
    return found.select(
        *bookings.columns,
        F.when(F.array_contains("_parent_phones", F.col("phone")), F.lit(1)).alias("duplicate_booking"))


def enrich_customers(bookings: DataFrame, statuses: list[str] = SUCCESS_STATUSES,
                     order_by: tuple[str, ...] = ("requested_date", "booking_id"),
                     threshold: float = 0.1, duplicates: bool = True,
                     heavy_rows: int | None = None, slice_ids: int | None = None) -> DataFrame:
    """Successful bookings with their customer's cohort, source, segment, rating and so on.

    Takes the output of ``with_revenue``. ``order_by`` numbers a customer's
    bookings and must end with ``booking_id``; ``("booking_id",)`` numbers them
    in dump order. Without ``duplicates`` the duplicate flag and its join are
    left out, which is all the cohort and customer reports need.

    The wide rows are shuffled once for all customer columns (statistics join,
    numbering) and once for the duplicate test. A customer who holds more than their share
    of the rows (above ``heavy_rows``, where given) is numbered in ranges of about
    ``slice_ids`` bookings, each starting from the prefix sum of the ranges before it.
    """
    if order_by[-1] != "booking_id":
        raise ValueError("order_by must end with booking_id")
    rows = present(bookings.where(F.col("status").isin(statuses)), "phone")
    facts = [
        F.count(F.lit(1)).alias("n_rows"),
        _first_booking("booking_month").alias("cohort_group"),
        _first_booking("booking_id").alias("_first_id"),
        *_acquisition_facts(), *_segment_facts(), *_rating_facts(), *_credits_facts(),
    ]
    stats = skew.built_once(rows.groupBy("phone").agg(*facts)).select(
        "phone", "n_rows", "successful_bookings", "cohort_group", "_first_id",
        _acquisition().alias("acquisition_source"), _segment(threshold).alias("customer_segment"),
        _only_dc().alias("only_dc"), _rating().alias("rating"), "_latest_credits")
    added = [c for c in stats.columns if c not in ("phone", "n_rows")]

    heavy = skew.heaviest(stats, "phone", floor=heavy_rows).select(
        F.col("phone").alias("_hp"), F.struct(*added).alias("_heavy"))
    places = [x for c in order_by for x in (F.col(c).isNull(), F.col(c))]
    marked = skew.cut(rows, "phone", places, "_slice", stats=stats, floor=heavy_rows, slice_rows=slice_ids)
    marked = marked.join(F.broadcast(heavy), F.col("phone") == F.col("_hp"), "left")

    # Only uncut rows meet this side, so its slice is -1 for every customer.
    light = stats.select(F.col("phone").alias("_lp"),
                         F.when(skew.zero_of("phone") == 0, -1).otherwise(-2).alias("_ls"),
                         F.struct(*added).alias("_light"))
    order = [F.col(c).asc_nulls_last() for c in order_by]
    in_slice = Window.partitionBy("phone", "_slice").orderBy(*order)
    flagged = duplicate_flag(marked, rows, heavy_rows) if duplicates else marked
    numbered = flagged.join(
        light, (F.col("phone") == F.col("_lp")) & (F.col("_slice") == F.col("_ls")), "left",
    ).withColumn("_nr", F.row_number().over(in_slice))

    before = Window.partitionBy("_op").orderBy("_os").rowsBetween(Window.unboundedPreceding, -1)
    offsets = marked.where(F.col("_slice") >= 0).groupBy(F.col("phone").alias("_op"), F.col("_slice").alias("_os")).agg(
        F.count(F.lit(1)).alias("_c")).select("_op", "_os", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    # one row for each range of a cut customer
    numbered = numbered.join(
        F.broadcast(offsets), (F.col("phone") == F.col("_op")) & (F.col("_slice") == F.col("_os")), "left")

    found = F.coalesce(F.col("_heavy"), F.col("_light"))
    computed = {
        "customer_credits", "successful_bookings", "cohort_group", "acquisition_source", "customer_segment",
        "only_dc", "booking_count", "rating", "duplicate_booking", "new_repeat", "nps",
    }
    return numbered.select(
        *[F.col(c) for c in bookings.columns if c not in computed],
        found["_latest_credits"].alias("customer_credits"),
        found["successful_bookings"].alias("successful_bookings"),
        found["cohort_group"].alias("cohort_group"),
        found["acquisition_source"].alias("acquisition_source"),
        found["customer_segment"].alias("customer_segment"),
        found["only_dc"].alias("only_dc"),
        (F.col("_nr") + F.coalesce("_before", F.lit(0))).cast("int").alias("booking_count"),
        found["rating"].alias("rating"),
        *(["duplicate_booking"] if duplicates else []),
        F.when(F.col("booking_id") == found["_first_id"], "first_booking")
        .otherwise("repeat_booking").alias("new_repeat"),
        nps_score(F.col("feedback")).alias("nps"),
    )
