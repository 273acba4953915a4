"""Every registered query against DuckDB running the equivalent SQL on the same tables."""

from __future__ import annotations

import pytest
from conftest import SF_DIR
from oracle import duck, duck_bag, spark_bag

import __spark_entry__ as entry

QUERIES = {name: fn for name, fn in entry.queries().items() if name not in entry.LLM_QUERIES}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name not in entry.LLM_ORACLES}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, con, name):
    columns, rows = spark_bag(QUERIES[name](spark, SF_DIR))
    sql_columns, sql_rows = duck_bag(con, ORACLES[name])
    assert columns == sql_columns
    assert rows == sql_rows


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
