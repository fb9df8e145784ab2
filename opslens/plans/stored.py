"""Customer histories: the enriched bookings folded by customer and day, stored once, bucketed by customer.

The customer reports group by phone first. From the stored table they read each customer's rows
in place, without the enrichment and without an exchange on phone. A history has one row
per customer, day, status, city and selection, so a customer with a third of
all bookings is no more than the days it was active on, and its bucket is no larger than
the others by more than that.

The reports here give what the functions of the same names in ``operators`` give on the bookings
themselves. Snapshot dates are whole days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import present
from ..functions.labels import COMPLETED_STATUSES, EXCLUDED_COHORTS
from ..operators import cohorts, customers

_KEYS = ["phone", "day", "status", "city", "cohort_group", "booking_month", "_garbage", "_repeat", "_good"]


def histories(enriched: DataFrame) -> DataFrame:
    """Rows of ``enrich_customers`` folded to one per customer, day, status, city and selection; no phone, no row."""
    day = F.col("requested_date")
    firsts = [F.min(F.when(F.col(c).isNotNull(), F.struct("booking_id", F.col(c).alias("value")))).alias(f"_first_{c}")
              for c in customers.CONTACT_COLUMNS]
    rows = present(enriched, "phone").withColumns(cohorts.selections()).withColumn("day", F.date_trunc("day", day).cast("date"))
    return rows.groupBy(*_KEYS).agg(
        F.count("booking_id").alias("bookings"), F.sum("total_revenue").alias("revenue"),
        F.sum("feedback").alias("feedback_sum"), F.count("feedback").alias("feedback_n"),
        F.count(day).alias("dated"), F.min(day).alias("first"), F.max(day).alias("last"),
        F.sum("successful_bookings").alias("successful_sum"), F.count("successful_bookings").alias("successful_n"),
        F.bool_and(F.col("only_dc").isNotNull()).alias("dry_cleaning"), *firsts)


def store(folded: DataFrame, name: str, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Writes histories as the table ``name``, bucketed and sorted by phone, one file a bucket, and reads it back.

    ``buckets`` defaults to the session's shuffle partitions, ``path`` to a folder of the
    table's name below the session's warehouse; both are shared by driver and executors.
    """
    spark = folded.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}"
    (folded.repartition(n, "phone").write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(n, "phone").sortBy("phone").saveAsTable(name))
    return spark.table(name)


def _in_city(kept: DataFrame, city: str | None) -> DataFrame:
    return kept if city is None else kept.where(F.col("city") == city)


def _measures():
    return [F.sum("bookings").alias("_bookings"), F.sum("revenue").alias("_revenue")]


def cohort_matrix(kept: DataFrame) -> DataFrame:
    return cohorts.matrix_of(kept, _measures())


def cohort_variants(kept: DataFrame, city: str | None = None, excluded: list[str] = EXCLUDED_COHORTS) -> DataFrame:
    return cohorts.variants_of(_in_city(kept, city), [
        *_measures(), F.sum("feedback_sum").alias("_fs"), F.sum("feedback_n").alias("_fn")], excluded)


def core_customers(kept: DataFrame, snapshots: list[tuple[str, str]], statuses: list[str] = COMPLETED_STATUSES,
                   fix_dc: bool = True) -> DataFrame:
    return customers.core_shares(kept.where(F.col("status").isin(statuses)), F.col("day").cast("timestamp_ntz"), [
        F.min("first").alias("first"), F.sum("successful_sum").alias("sum"), F.sum("successful_n").alias("n"),
        F.bool_and("dry_cleaning").alias("dc"), F.sum("revenue").alias("gmv")], snapshots, fix_dc)


def marketing_master(kept: DataFrame, city: str | None = None, as_of=None,
                     days: list[int] = customers.INACTIVE_DAYS) -> DataFrame:
    return customers.contact_rows(_in_city(kept, city), [
        *[F.min(f"_first_{c}")["value"].alias(c) for c in customers.CONTACT_COLUMNS],
        F.try_divide(F.sum("feedback_sum").cast("double"), F.sum("feedback_n")).alias("avg_feedback"),
        F.sum("dated").alias("total_bookings"), F.max("last").alias("last_booking_date")], as_of, days)
