"""Time the shuffle-heavy headline queries; prints one JSON line.

The feature table, which most evaluation queries start from, is landed once and timed by itself."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "Q1_exact_duplicates",
    "Q3_appearance_dedup",
    "T4_resolve_lookback",
    "A1_lookback_join",
    "A18_feature_table",
    "A7_value_asof",
    "A7_event_asof",
    "A8_trailing_median",
    "A10_context_sums",
    "A15_exposure",
    "L4_funnel",
    "M4_full_grid",
    "E2_metrics",
    "E3_cluster_bootstrap",
    "E16_residual_bands",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from pitlake.bindings import Tables
    from pitlake.plans.study import keep_landed, landed_features
    from registry.queries import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()
    times = {}
    keep_landed()
    start = time.time()
    landed_features(Tables(spark, folder))
    times["landed_features"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
