"""Hard negatives: bounds, the curve, pruning, and the whole search against brute force."""

import numpy as np
import pytest
from conftest import SF0001
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shockspark.llm import hardneg
from shockspark.llm.queries import QUERIES


def brute(rows, positives=5, negatives=5, low=80, high=100, scale=256):
    """(id, label, vector) rows by definition; vectors of Python integers."""
    rows = [(i, c, [int(np.floor(scale * x)) for x in v]) for i, c, v in rows
            if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a in {(i, c, tuple(v)) for i, c, v in rows if i % 100 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a[2], v)), i, c) for i, c, v in rows if i != a[0] and len(v) == len(a[2]))
        for p, pid, _ in [s for s in scored if s[2] == a[1]][:positives]:
            below = [s for s in scored if s[2] != a[1] and low * -p <= 100 * -s[0] <= high * -p][:negatives]
            out += [(a[0], pid, n, i, -p, -s) for n, (s, i, _) in enumerate(below, 1)]
    return sorted(out)


def mined(df, **k):
    return sorted(map(tuple, hardneg.mine(df, F.col("vec_id") % 100 == 0, **k).collect()))


SCHEMA = "vec_id long, embedding array<double>, label int"


def clustered(n=1500, dims=6, seed=3):
    """Tight clusters around far points, labels mixed in each."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dims))
    v = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, dims)) * 0.02
    return [(i, int(rng.integers(0, 3)), x.tolist()) for i, x in enumerate(v)]


def test_registered_query_is_brute_force(spark):
    table = spark.read.parquet(f"{SF0001}/embeddings.parquet").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [float(x) for x in r.embedding]) for r in table]
    assert sorted(map(tuple, QUERIES["op11_hard_negatives"](spark, SF0001).collect())) == brute(rows)


def test_clusters_are_pruned_and_exact(spark):
    rows = clustered()
    df = spark.createDataFrame([(i, v, c) for i, c, v in rows], SCHEMA)
    small = dict(block=8, group_bytes=8 * 6 * 64, anchors=4)
    assert mined(df, **small) == brute(rows)
    placed = hardneg.ordered(df, F.col("vec_id") % 100 == 0, "vec_id", "embedding", "label", 256.0)
    groups, batches = hardneg.candidate_groups(placed, 8, 8 * 6 * 64), hardneg.anchor_batches(placed, 1)
    found = hardneg.search(groups, batches, True, 5, 8)
    assert found.count() == 5 * 15
    lifted = hardneg._lifted(batches, found, 5)
    blocks = sum(len(r.least_label) // 8 for r in groups.select("least_label").collect())
    wanted = hardneg.reading(groups, lifted, True).agg(F.sum("wanted")).first()[0]
    assert wanted < 0.25 * 15 * blocks


def test_odd_rows(spark):
    """Nulls, odd numbers, lengths, ties, repeated rows and ids, clashing names."""
    inf, nan = float("inf"), float("nan")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 1, [1.0, 0.5]), (2, 1, [1.0, 0.5]), (3, 2, [1.0, 0.4]), (3, 2, [1.0, 0.4]),
            (4, 2, [0.9, 0.5]), (5, None, [1.0, 0.5]), (6, 2, None), (7, 2, [1.0, None]), (8, 2, [nan, 0.5]), (9, 2, [inf, 0.5]), (None, 2, [1.0, 0.4]),
            (100, 1, []), (101, 1, []), (102, 2, []), (200, 2, [1.0, 2.0, 3.0]), (201, 2, [1.0, 2.0, 3.1]), (300, 5, [1.0, 0.5]), (400, 1, [-1.0, 0.0])]
    clash = [(i, v, c, 1, "x", b"", 2.0) for i, c, v in rows]
    df = spark.createDataFrame(clash, SCHEMA + ", `group` int, key string, q binary, `a.b` double")
    # equal anchor rows are one anchor
    assert mined(df) == brute(rows)
    assert mined(df.limit(0)) == []
    assert mined(spark.createDataFrame([(None, None, None)] * 3, SCHEMA)) == []


def test_large_components_are_exact(spark):
    rows = [(0, 1, [1e8, 1.0]), (1, 1, [1e5, 7.0]), (2, 2, [1e5, 6.0]), (3, 2, [1e5, 6.5]), (4, 2, [9e4, 0.0]), (5, 1, [1e5, 7.25])]
    beyond = [(6, 1, [1e25, 0.0]), (7, 2, [1e25, 0.0]), (8, 2, [1.7e308, 0.0])]
    df = spark.createDataFrame([(i, v, c) for i, c, v in rows + beyond], SCHEMA)
    assert mined(df) == brute(rows) != []


@pytest.mark.parametrize("dims,levels", [(1, 3), (2, 3), (3, 2), (4, 1)])
def test_curve_visits_every_cell_by_single_steps(dims, levels):
    cells = np.indices((1 << levels,) * dims).reshape(dims, -1).T
    points = (cells + 0.5) / (1 << levels) * 4 - 2  # centre 0, spread 1
    keys = [k.tobytes() for k in hardneg.hilbert(points, 0.0, 1.0, levels)]
    path = cells[np.argsort(np.array(keys, dtype=object))]
    assert len(set(keys)) == len(cells)
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**31), st.sampled_from([1, 40, 2**20, 2**40]))
def test_bounds_hold(seed, size):
    rng = np.random.default_rng(seed)
    a, v = (np.floor(rng.normal(size=(n, 5)) * size) for n in (7, 33))
    low, high, first, last = hardneg.zone_map(np.arange(33), v, 4)
    least, most = hardneg.bounds(a, low, high)
    for i, x in enumerate(a):
        for j, y in enumerate(v):
            score = sum(int(p) * int(q) for p, q in zip(x, y))
            assert least[i, j // 4] <= score <= most[i, j // 4] and first[j // 4] <= j <= last[j // 4]
