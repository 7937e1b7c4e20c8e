"""Every query of the comment and post engine against its DuckDB oracle on the smoke tables (row count + values)."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from corpusforge.plans.queries import REGISTRY
from corpusforge.plans.views import BASE_TABLES

QUERIES = {k: E.queries()[k] for k in REGISTRY}
ORACLE = {k: v for k, v in E.oracle_sql().items() if k in REGISTRY}


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return str(int(f)) if f == int(f) and abs(f) < 1e15 else f"{f:.6g}"
    return str(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["drop_reason", "n"] and df.count() == 4


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, sf_dir, duck, key):
    df = QUERIES[key](spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLE[key])
    want = _rows([d[0] for d in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert got == want
