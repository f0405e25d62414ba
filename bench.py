"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the tables and cores. Every query is
computed in full (no-op sink); its time is the better of two runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lotframe.catalog import QUERIES, derived  # noqa: E402

HEADLINE = (
    "ingest_all",
    "ingest_audit",
    "grid_scan_csv",
    "table_segments",
    "kv_last_wins",
    "lots_with_metrics",
    "clean_lots",
    "append_dedupe",
    "beta_paired",
    "beta_truncated",
    "beta_holdings",
    "metrics_report",
)
RUNS = 2


def seconds(action) -> float:
    began = time.perf_counter()
    action()
    return round(time.perf_counter() - began, 3)


def compute(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lotframe-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # The JVM never compiles methods above 8,000 bytes of bytecode; wide projections
        # run faster as several small generated methods than as one of those.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The derived reports are written once and shared by the report queries.
    times = {"render_reports": seconds(lambda: derived.report_table(spark, sf_dir))}
    for name in HEADLINE:
        times[name] = min(seconds(lambda: compute(QUERIES[name](spark, sf_dir))) for _ in range(RUNS))
    total = round(sum(times.values()), 3)
    result = {
        "metric": "total seconds of headline queries",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
