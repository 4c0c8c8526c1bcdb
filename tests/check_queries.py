"""Compares registered queries with their SQL: python tests/check_queries.py [folder] [name ...]"""

from __future__ import annotations

import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]

import compare  # noqa: E402
from pulsemart.plans import catalog  # noqa: E402
from pulsemart.session import build_session  # noqa: E402


def main(folder: str, names: list[str]) -> int:
    spark = build_session("check", "local[8]", 8, {"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = compare.connect(folder)
    queries, oracles = catalog.queries(), catalog.oracle_sql()
    bad = 0
    for name in names or queries:
        started = time.time()
        try:
            columns, rows = compare.spark_rows(queries[name](spark, folder))
            took = time.time() - started
            expected_columns, expected = compare.sql_rows(con, oracles[name])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {type(e).__name__}: {str(e)[:600]}", flush=True)
            continue
        if columns != expected_columns:
            bad += 1
            print(f"FAIL {name}: columns {sorted(set(columns) ^ set(expected_columns))}", flush=True)
        elif rows != expected:
            bad += 1
            extra = [r for r in rows if r not in set(expected)][:2]
            missing = [r for r in expected if r not in set(rows)][:2]
            print(f"FAIL {name}: rows {len(rows)} vs {len(expected)}; columns {columns}\n  spark {extra}\n  sql   {missing}", flush=True)
        else:
            print(f"ok   {name}: {len(rows)} rows, {took:.2f}s", flush=True)
    print(f"{len(names or queries)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]) else 0)
