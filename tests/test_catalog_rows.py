"""No oracle entry may be vacuous: each returns rows at the scale the other tests use."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF0001

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF0001):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{os.path.join(SF0001, f)}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle_returns_rows(con, name):
    assert con.execute(f"SELECT COUNT(*) FROM ({SQL[name]})").fetchone()[0] > 0
