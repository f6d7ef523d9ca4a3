"""Every query of the core against its SQL; those without SQL must run and keep their schema."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from telemill.plans import core_problems, reference_queries

from .oracle import assert_same, connect

QUERIES = core_problems.QUERIES | reference_queries.QUERIES
SQL = core_problems.ORACLE_SQL | reference_queries.ORACLE_SQL


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, con, name):
    assert_same(QUERIES[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert df.columns and rows and all(len(r) == len(df.columns) for r in rows)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
