"""Every registered query against its SQL, on the smallest tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
CATALOG = __import__("siftline.plans.catalog", fromlist=["x"])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return None if v != v else round(float(v), 5) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def rows(data, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(CATALOG.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    got = CATALOG.QUERIES[name](spark, SF)
    want = duck.sql(CATALOG.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


def test_all_queries_are_listed():
    assert set(CATALOG.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "item_id", "score", "rank"]


@pytest.mark.parametrize("name", ["stratified_select", "gbt_rank_top50"])
def test_without_sql(spark, name):
    out = CATALOG.QUERIES[name](spark, SF)
    assert out.count() > 0
