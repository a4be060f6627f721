"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    rel = duck.sql(catalogue.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = entry.queries()[name](spark, str(DATA))
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_without_the_corpus_part(monkeypatch):
    import importlib

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("tidemark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        again = importlib.reload(entry)
        assert set(again.queries()) == set(catalogue.queries()) and set(again.oracle_sql()) <= set(again.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
