"""Every registered query with check SQL must return the SQL's rows, names, values and types."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, database

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], SQL[name], SF) is None


def test_names_agree():
    assert set(SQL) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() == 1
