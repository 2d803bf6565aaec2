"""Every query against its SQL, whole results."""

import os

import pytest

import __spark_entry__ as entry
from check import connection, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    ours = entry.queries()[name](spark, SF_DIR).toPandas()
    theirs = con.execute(entry.oracle_sql()[name]).df()
    assert difference(ours, theirs) is None


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.ORACLES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
