"""Every registered query against its SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    ok, text = compare(name, spark, con, SF)
    assert ok, text


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = entry.queries()[name](spark, SF)
    assert len(df.collect()) > 0 and len(set(df.columns)) == len(df.columns)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
