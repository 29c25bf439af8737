"""Every registered query against its DuckDB counterpart: names, types and all values."""

import os

import pytest

from __spark_entry__ import ENTRY_FOLDER, entry
from compare import compare, connect
from tillscope.oracle.sql import oracle_queries
from tillscope.queries import QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", ENTRY_FOLDER)
ORACLE = oracle_queries()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry(spark).columns[0] == "date" and entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLE[name]) == []
