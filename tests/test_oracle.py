"""Every query with a SQL twin gives the same rows and values as the twin on the given tables."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from tests.oracle import compare, connect

QUERIES, SQLS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_SMALL)


def test_every_twin_belongs_to_a_query():
    assert set(SQLS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQLS))
def test_matches_sql(spark, con, sf_dir, name):
    result = compare(spark, con, sf_dir, QUERIES[name], SQLS[name])
    assert result["ok"], result["note"]


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert {"customerid", "billing_interval", "interval_confidence"} <= set(df.columns)
    assert df.count() > 0
