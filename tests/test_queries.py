"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import compare

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return compare.database(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    diff, _, _, n = compare.check(spark, con, FOLDER, name)
    assert diff is None
    assert n > 0 or name in ("resume_cities", "disc_join_points")


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["city", "pid", "road_density", "building_density", "poi_density"] and df.count() == 150
