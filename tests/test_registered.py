"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def test_keys():
    assert set(entry.ORACLES) <= set(entry.QUERIES)
    assert set(entry.QUERIES) - set(entry.ORACLES) == {
        "kmeans_ml", "two_level_fit", "pruned_search_fitted"
    }


@pytest.mark.parametrize("name", list(entry.QUERIES))
def test_query(spark, con, name):
    same, note, _ = compare(spark, con, name, SF)
    assert same, note


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["qid", "neighbor", "distance", "rank"]
    assert rows.count() > 0
