"""Headline timings: one JSON line with the seconds of each query.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Every
query is run to completion into the no-op sink: once to warm up, then
$BENCH_RUNS times (default 1); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from opslens.session import build_session  # noqa: E402
from registry.queries import QUERIES  # noqa: E402

HEADLINE = [
    "merge_bookings", "enrich_customers", "cohort_matrix", "cohort_variants", "cohorts_for_good_localities",
    "nps_weekly", "reason_share", "pickup_funnel", "assign_ofd", "delivery_funnel", "delivery_funnel_v1",
    "callback_status", "callback_kpis", "handling_time", "business_frt", "frt_distribution", "resolution_time",
    "issue_share", "core_customers", "customer_profile", "marketing_master", "leads_without_bookings",
    "courier_productivity", "courier_extract",
]


def seconds(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    timings = {}
    for name in names:
        seconds(QUERIES[name], spark, sf_dir)
        timings[name] = round(statistics.median(seconds(QUERIES[name], spark, sf_dir) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
