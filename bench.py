"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (folder of the test tables), BENCH_CPUS (cores),
BENCH_RUNS (timed runs per query, after one warm-up).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from storeflow import registry
from storeflow.session import SETTINGS

HEADLINE = (
    "clean_hourly_sales", "clean_raw_sales", "hourly_agg", "promo_pivot", "promo_left_join",
    "cyclical_encode", "binary_flags", "feature_stats", "standard_scale", "label_dictionary", "label_encode",
    "model_features", "forecast_vs_actual", "comparison_summary", "monthly_comparison", "slot_totals",
    "enrich_transactions", "store_lookup", "ext_sales_price", "pos_stats", "units_by_category", "recent_feed",
    "time_index", "training_sequences", "csv_scan", "stream_slot_actuals", "stream_dedupe",
)


def session(cpus: str) -> SparkSession:
    builder = SparkSession.builder
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.master(f"local[{cpus}]")
        .appName("storeflow-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        # The test files are a few MB: let a scan use all cores.
        .config("spark.sql.files.openCostInBytes", "1MB")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(spark: SparkSession, query, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    queries, _ = registry.load()
    timed = {}
    for name in names or HEADLINE:
        seconds(spark, queries[name], folder)
        timed[name] = round(statistics.median(seconds(spark, queries[name], folder) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timed.values()), 3), "unit": "sec",
        "queries": timed, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main(sys.argv[1:])
