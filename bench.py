"""Times the headline queries and prints one JSON line.

Every query runs to completion into Spark's no-op sink, so all rows and columns are
computed and nothing is measured but Spark's own work. The best of `BENCH_RUNS` runs
counts; the first run also warms the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ferrywright.session import configure  # noqa: E402
from showcase import QUERIES  # noqa: E402

HEADLINES = [
    "load_orders",
    "load_orders_rows",
    "load_lineitem",
    "conform_mysql",
    "target_sqlite",
    "row_reasons",
    "duplicate_keys",
    "first_row_wins",
    "duplicate_rejects",
    "fk_orphan_rows",
    "fk_composite",
    "page_numbers",
    "row_numbers_shared_key",
    "keyset_page",
    "insert_script",
    "csv_roundtrip",
    "trim_text",
    "sql_literal",
    "column_profile",
    "reconcile_by_key",
    "bag_difference",
    "resume_load",
    "import_counts",
    "jdbc_parallel",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    timings: dict[str, float] = {}
    for name in HEADLINES:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            elapsed = time.perf_counter() - start
            best = elapsed if best is None else min(best, elapsed)
        timings[name] = round(best, 3)
    result = {
        "metric": "total_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
