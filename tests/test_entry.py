"""The driver contract: every query runs, and agrees with its SQL."""

from __future__ import annotations

import importlib.util

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

NAMES = [n for n in entry.queries() if n not in entry._llm()[0]]


def plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in rows) == want


def test_engine_imports_without_llm():
    assert importlib.util.find_spec("cairnfield.queries")
    assert not any(n.startswith("op") and n[2:3].isdigit() for n in NAMES)
