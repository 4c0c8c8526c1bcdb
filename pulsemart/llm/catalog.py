"""All registered queries of this subpackage, the pipeline among them."""

from __future__ import annotations

import corpus_pipeline

from . import queries as _queries  # noqa: F401  (it registers)
from .registry import ORACLES, QUERIES


def queries():
    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
