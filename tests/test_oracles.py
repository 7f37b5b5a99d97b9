"""Every query that SQL can express gives what DuckDB gives on the same tables."""

import os

import pytest

import __spark_entry__ as contract
from comparing import duck, duck_rows, spark_rows
from comparing import SF

SF_DIR = os.environ.get("ORACLE_SF_DIR", SF)


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_agrees_with_sql(spark, con, name):
    expected = duck_rows(con, contract.oracle_sql()[name])
    got = spark_rows(contract.queries()[name](spark, SF_DIR))
    assert got[0] == expected[0]
    assert len(expected[1]) > 0
    assert got[1] == expected[1]


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert contract.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 4
