"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs once as warm-up, then 3 timed runs; the per-query value is the
median.  Queries execute completely through the ``noop`` sink (no collect to
the driver).  Prints ONE JSON line.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "permit_daily", "stream_permits", "parse_ts_formats", "parse_ts_mixed", "expand_daily", "keep_last",
    "accumulate", "lookup_fill", "replace_by_key", "analyze_diff", "split_periods", "assessment_cards",
    "restore_state", "forecast_daily", "calendar", "mask_people", "plan_rows", "docs_items",
    "message_headers", "keep_latest", "archive_plan", "milestone_long", "enrich_missing",
    "catalog_profile", "landing_permits", "forecast_json", "sheet_fuel_usage", "header_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("tidemark-bench")
             .config("spark.ui.enabled", "false")
             .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
             .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(8, int(cpus) * 2))))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from tidemark.plans.queries import QUERIES
    names = only or [q for q in HEADLINE if q in QUERIES]
    times: dict[str, float] = {}
    for name in names:
        fn = QUERIES[name]

        def run() -> float:
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        run()
        times[name] = round(statistics.median(run() for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
