"""Every query outside the optional subpackage against its SQL in DuckDB, over whole tables."""

import math
import os

import duckdb
import pytest

from wayfold.plans.catalog import ORACLES, QUERIES

DATA = os.environ.get("WAYFOLD_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    values = got.collect()
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got.columns, values) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).columns == ["tree_id", "id", "url", "page_loaded_at", "parent_id"]
