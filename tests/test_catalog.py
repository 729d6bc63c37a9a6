"""Every registered query runs; those with SQL give the same rows as the SQL."""

import pytest

import __spark_entry__ as entry
from harness import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns and len(df.collect()) > 0
    else:
        assert difference(df, con, sql) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
