import pytest

import __spark_entry__ as entry
from larkspur.plans import queries as core
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_equals_sql(spark, con, name):
    got, want = core.QUERIES[name](spark, SF).toPandas(), con.sql(core.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_without_sql_runs(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(core.SQL) <= set(core.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
