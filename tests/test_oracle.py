"""Every registered query equals its SQL on DuckDB over the same tables."""

import pytest
from oracle_check import connect, difference

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, ROOT).toPandas()
    text = entry.oracle_sql().get(name)
    if text is None:
        assert len(got) > 0
    else:
        assert difference(got, con.execute(text).fetchdf()) is None


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1500
