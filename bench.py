"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores. Every query
is run to the end into a sink that keeps nothing; the time is the better of two
runs after a warm-up at the smallest scale.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from workload.queries import QUERIES

HEADLINE = (
    "flt_keep_chain",
    "flt_audit",
    "nrm_clean_lower",
    "nrm_alias",
    "nrm_array_parse",
    "nrm_audit",
    "key_status",
    "dup_keys_raw",
    "details_inner",
    "details_full",
    "details_set",
    "mismatches",
    "per_column",
    "per_column_hot_key",
    "summary",
    "metrics_derived",
    "high_risk",
    "csv_roundtrip",
    "cmp_tolerance_hot_key",
)


def run(spark: SparkSession, name: str, folder: str) -> float:
    spark.catalog.clearCache()
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("counterfoil-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    times = {}
    for name in names:
        if os.path.isdir(small):
            run(spark, name, small)
        times[name] = round(min(run(spark, name, folder) for _ in range(2)), 3)
    result = {
        "metric": "total of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
