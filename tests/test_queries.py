"""Every registered query against its SQL, on the smallest test tables."""

from __future__ import annotations

import os

import oracle
import pytest

import __spark_entry__ as driver
from docsieve.plans import all_queries, all_sql

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_names():
    assert set(SQL) == set(QUERIES)
    assert QUERIES.items() <= driver.queries().items()
    assert SQL.items() <= driver.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert oracle.compare(name, QUERIES[name](spark, SF), con, SQL[name]) is None


def test_entry(spark):
    assert driver.entry(spark).columns == ["_query", "lang", "n", "avg_n_chars"]
