"""Every registered query with SQL gives the same rows as DuckDB."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir).toPandas(), con.sql(ORACLES[name]).df()) == ""


def test_entry_runs(spark):
    assert entry(spark).count() > 0


def test_oracles_name_registered_queries():
    assert set(ORACLES) <= set(QUERIES)
