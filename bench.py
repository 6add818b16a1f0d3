"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the number of threads. Each
query is planned and run to its last row; the best of ``BENCH_RUNS`` runs counts,
after one run that warms the JVM up.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from doorflux.session import build_session  # noqa: E402
from workloads.queries import QUERIES  # noqa: E402

HEADLINE = (
    "traffic_normalized",
    "business_day_filter",
    "store_filter",
    "kpi_all",
    "kpi_all_store",
    "kpi_all_year",
    "kpi_all_lineitem",
    "growth",
    "trend_hour",
    "trend_day",
    "trend_month",
    "trend_month_lineitem",
    "store_comparison",
    "store_share",
    "report_table",
    "report_table_hour",
    "report_table_lineitem",
    "report_summary",
    "error_logs",
    "latest_record_time",
    "hourly_rollup",
    "dashboard_payload",
    "clean_traffic",
    "clean_errors",
    "validate_reject",
    "validate_reject_errors",
    "duplicate_keys",
    "partitioned_roundtrip",
    "incremental_two_batches",
    "stream_incremental",
    "run_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "doorflux-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        timings = []
        for _ in range(runs + 1):
            spark.catalog.clearCache()
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings.append(time.perf_counter() - started)
        seconds[name] = round(min(timings[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total time of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
