"""Every registered query against its SQL."""

import os

import pytest
from oracle import connect, differences

import __spark_entry__ as entry
from corpus_spark.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    assert differences(df, con, ORACLES[name]) is None


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["split", "output", "n"] and df.count() > 0


def test_comparison_notices_a_difference(spark, con):
    df = spark.sql("SELECT 1 AS a")
    assert differences(df, con, "SELECT 1 AS a") is None
    assert differences(df, con, "SELECT 2 AS a")
    assert differences(df, con, "SELECT 1::BIGINT AS a")
    assert differences(df, con, "SELECT 1 AS b")
    assert differences(df, con, "SELECT 1 AS a UNION ALL SELECT 1")
