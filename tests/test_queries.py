"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from check import TABLES, canonical

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    want = db.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = canonical(got), canonical(want)
    assert got.equals(want), got.compare(want).head() if len(got) == len(want) else (len(got), len(want))


def test_entry(spark):
    assert entry.entry(spark).columns == ["category", "severity", "subject", "first_sec", "last_sec", "n"]
