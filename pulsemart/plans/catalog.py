"""All registered queries and their comparison SQL."""

from __future__ import annotations

from . import change_queries, device_queries, quality_queries, report_queries, stored_queries  # noqa: F401  (they register)
from .registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
