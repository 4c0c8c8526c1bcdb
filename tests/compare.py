"""Exact comparison of a Spark result with the same question asked in plain SQL."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, decimal.Decimal)):
        return (2, str(value))
    if isinstance(value, float):
        return (0, "") if math.isnan(value) else (3, repr(value))
    if isinstance(value, (dt.datetime, dt.date)):
        return (4, value.isoformat())
    return (5, str(value))


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def spark_rows(df):
    return sorted(df.columns), normal(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql: str):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return sorted(columns), normal(columns, cursor.fetchall())
