"""Every catalogue query against its oracle SQL (DuckDB) on sf0.001."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF0001

SQL = E.oracle_sql()
NAMES = sorted(SQL)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF0001):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{os.path.join(SF0001, f)}')")
    return c


def _norm(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat") and not isinstance(v, str):
        return v.isoformat()[:10]
    return v


def _key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    q = E.queries()[name]
    df = q(spark, SF0001)
    res = con.execute(SQL[name])
    ocols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(ocols)
    idx = [df.columns.index(c) for c in ocols]
    srows = sorted((tuple(_norm(r[i]) for i in idx) for r in df.collect()), key=_key)
    orows = sorted((tuple(_norm(v) for v in r) for r in res.fetchall()), key=_key)
    assert len(srows) == len(orows)
    assert srows == orows


def test_entry_runs(spark):
    df = E.entry(spark)
    out = df.collect()
    assert len(out) == 10
    assert {"destination_id", "resilience_score", "resilience_rank"} <= set(df.columns)


def test_every_query_has_a_callable():
    qs = E.queries()
    assert set(SQL) <= set(qs)
    assert len(qs) >= 140
