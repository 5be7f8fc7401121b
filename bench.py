"""Time the headline queries; prints one JSON line.

Every query is timed on its whole result (written to a no-op sink), jobs that run while the
query is built included.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "t3_whole_cohort",
    "j1_measures_in_window",
    "j3_washout_anti",
    "j4_arm_semi",
    "j7_latest_measure",
    "a2_drug_pivot",
    "a6_quantiles",
    "l1_top_one",
    "w1_last_per_month",
    "j8_nearest_match",
    "e7_cox_weighted",
    "e9_iptw_given_scores",
    "e11_cross_fitted",
    "e15_bootstrap",
    "e17_pooling",
    "m10_imputation_run",
    "r5_first_event",
)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from trialweave.catalog import QUERIES

    for t in ("customer", "orders", "lineitem"):  # file system and JVM warm-up
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
