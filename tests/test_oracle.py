"""Every query runs, with a plan that holds on large tables, and gives the same rows in DuckDB if it has an SQL twin."""

import pytest

import oracle
from __spark_entry__ import entry, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", list(queries()))
def test_spark_and_sql_agree(spark, con, name):
    assert oracle.difference(spark, con, name, FOLDER) is None


def test_entry(spark):
    assert entry(spark).count() > 0
