"""Every registered query against its DuckDB oracle on the smallest test tables."""

import pytest

import __spark_entry__ as E
from keelson import queries as _queries
from tools.check_oracle import compare, duck

SF_SMALL = "/root/testdata/sf0.001"

QUERIES = _queries.QUERIES
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, msg, _, tmis = compare(spark, con, SF_SMALL, QUERIES[name], ORACLE.get(name))
    assert ok, msg
    assert not tmis, tmis


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "verdict" in df.columns
