"""Property tests of the distributed helpers against numpy / pandas on random data
(ties, nulls, several value ranges)."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shockspark.functions.quantiles import quantiles
from shockspark.functions.ranking import spearman, value_positions, with_rank

values = st.lists(st.one_of(st.none(), st.integers(-20, 20).map(float), st.floats(-1e3, 1e3, allow_nan=False)),
                  min_size=1, max_size=60)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _frame(spark, xs):
    return spark.createDataFrame([(x,) for x in xs], "v double").repartition(3)


@SETTINGS
@given(xs=values, desc=st.booleans())
def test_rank_matches_pandas(spark, xs, desc):
    df = _frame(spark, xs)
    got = {r["v"]: r["rk"] for r in with_rank(df, "v", "rk", descending=desc).distinct().collect()
           if r["v"] is not None}
    s = pd.Series([x for x in xs if x is not None], dtype=float)
    want = dict(zip(s, s.rank(method="min", ascending=not desc).astype(int)))
    assert got == want


@SETTINGS
@given(pairs=st.lists(st.tuples(st.integers(-3, 3).map(float), st.integers(-3, 3).map(float)), min_size=2, max_size=60))
def test_spearman_matches_pandas(spark, pairs):
    got = spearman(spark.createDataFrame(pairs, "x double, y double"), "x", "y").first()[0]
    x, y = (pd.Series(c).rank() for c in zip(*pairs))
    want = x.corr(y) if x.nunique() > 1 and y.nunique() > 1 else None
    assert got is None if want is None else got == pytest.approx(want, abs=1e-9)


@SETTINGS
@given(xs=values, ranges=st.integers(1, 7), desc=st.booleans())
def test_positions_cover_every_row_once(spark, xs, ranges, desc):
    pos = value_positions(_frame(spark, xs), "v", descending=desc, ranges=ranges).collect()
    n = sum(1 for x in xs if x is not None)
    spans = sorted((r["_before"], r["_before"] + r["_k"]) for r in pos)
    assert sum(r["_k"] for r in pos) == n
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    order = sorted(pos, key=lambda r: r["_before"])
    vals = [r["v"] for r in order]
    assert vals == sorted(vals, reverse=desc)


@SETTINGS
@given(xs=values, q=st.sampled_from([0.0, 0.25, 0.5, 0.9, 0.99, 1.0]))
def test_exact_quantile_matches_numpy(spark, xs, q):
    got = quantiles(_frame(spark, xs), "v", {"q": q}).first()["q"]
    arr = np.array([x for x in xs if x is not None], dtype=float)
    if arr.size == 0:
        assert got is None
    else:
        assert got == pytest.approx(float(np.quantile(arr, q)), rel=1e-12, abs=1e-9)


@SETTINGS
@given(xs=values, q=st.sampled_from([0.0, 0.5, 0.9, 0.99, 1.0]))
def test_median_and_filled_quantile_matches_numpy(spark, xs, q):
    from shockspark.functions.quantiles import median_and_filled_quantile

    m, p = median_and_filled_quantile(_frame(spark, xs), "v", q)
    arr = np.array([x for x in xs if x is not None], dtype=float)
    if arr.size == 0:
        assert m is None and p is None
        return
    med = float(np.quantile(arr, 0.5))
    filled = np.array([med if x is None else x for x in xs], dtype=float)
    assert m == pytest.approx(med, rel=1e-12, abs=1e-9)
    assert p == pytest.approx(float(np.quantile(filled, q)), rel=1e-12, abs=1e-9)
