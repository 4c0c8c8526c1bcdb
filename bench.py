"""Times the headline queries: one warm-up, median of three, every row computed (noop sink).

Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores, BENCH_QUERIES a
comma-separated list of other registered queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pulsemart.plans import catalog  # noqa: E402
from pulsemart.session import build_session  # noqa: E402

HEADLINE = [
    "hourly_stats",
    "usage_sessions",
    "customer_prosthesis",
    "mart_rows",
    "daily_rollup",
    "user_daily",
    "user_summary",
    "report_list",
    "daily_detail",
    "daily_document",
    "list_document",
    "fleet_daily",
    "user_daily_cdc",
    "latest_devices",
    "customer_data",
    "decoded_device_changes",
    "consent_history",
    "merged_profiles",
    "mart_violations",
    "access_log",
]
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        None if cpus == "*" else int(cpus),
        {"spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.log.level": "ERROR"},
    )
    queries = catalog.queries()
    seconds = {}
    for name in names:
        runs = []
        for _ in range(RUNS + 1):
            started = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    rows = {t: spark.read.parquet(f"{folder}/{t}.parquet").count() for t in ("events", "orders", "lineitem", "customer")}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "input_rows": rows,
            }
        )
    )


if __name__ == "__main__":
    main()
