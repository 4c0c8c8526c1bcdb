"""Every registered query against its SQL, value for value."""

from __future__ import annotations

import os

import compare
import pytest

from pulsemart.plans import catalog

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="sample tables are not here")


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


def test_every_query_has_its_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    columns, rows = compare.spark_rows(catalog.queries()[name](spark, FOLDER))
    expected_columns, expected = compare.sql_rows(con, catalog.oracle_sql()[name])
    assert columns == expected_columns
    assert rows == expected
    assert rows, "a query that finds nothing proves nothing"
