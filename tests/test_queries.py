"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest
from build import SMALL

import __spark_entry__ as entry
from tools.check import normal

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
ORACLE = entry.oracle_sql()
SLOW = ("m1", "s04", "s05", "s06")  # fitted models and repeated streams: covered by their own tests


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def test_sql_only_for_registered_queries():
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in ORACLE if not n.startswith(SLOW)))
def test_query_equals_sql(spark, db, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    want = db.execute(ORACLE[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
