"""Tail probabilities and the signed-rank test against other ways to the same values."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from shockspark.functions.distributions import log_gamma, normal_p, student_p
from shockspark.operators.series import signed_rank


def student_closed(t, v):
    """The finite sums for whole degrees of freedom."""
    theta = math.atan(abs(t) / math.sqrt(v))
    c, total = math.cos(theta), 0.0
    if v % 2:
        term = c
        for k in range((v - 1) // 2):
            total += term
            term *= c * c * (2 * k + 2) / (2 * k + 3)
        return 1 - 2 / math.pi * (theta + math.sin(theta) * total)
    term = 1.0
    for k in range(v // 2):
        total += term
        term *= c * c * (2 * k + 1) / (2 * k + 2)
    return 1 - math.sin(theta) * total


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 7.25, 100.0, 5000.0, 123456.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", log_gamma(F.col("x")).alias("g")).collect()
    assert all(abs(r.g - math.lgamma(r.x)) < 1e-10 * max(1, abs(math.lgamma(r.x))) for r in got)


def test_student_p_is_the_closed_form(spark):
    cases = [(t, n - 1) for n in (2, 3, 4, 5, 10, 29, 30, 31, 100, 999, 1000, 5001, 10_000) for t in (0.0, 1e-6, 0.3, -1.0, 1.96, 2.5, 6.0, 40.0)]
    got = spark.createDataFrame(cases, "t double, v int").select("t", "v", student_p(F.col("t"), F.col("v")).alias("p")).collect()
    assert all(abs(r.p - student_closed(r.t, r.v)) < 1e-9 and 0 <= r.p <= 1 for r in got)
    odd = spark.createDataFrame([(1.0, 0), (None, 5), (1.0, None)], "t double, v int").select(student_p(F.col("t"), F.col("v")).alias("p"))
    assert [r.p for r in odd.collect()] == [None] * 3


def test_normal_p_is_erfc(spark):
    zs = [0.0, 1e-9, -0.5, 1.0, 1.96, -3.3, 5.0, 8.0, 40.0]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", normal_p(F.col("z")).alias("p")).collect()
    assert all(abs(r.p - math.erfc(abs(r.z) / math.sqrt(2))) < 1e-12 for r in got)


def brute(diffs):
    """All sign patterns of the mean ranks."""
    d = sorted((abs(x), x) for x in diffs if x)
    ranks = []
    for size, group in itertools.groupby(d, key=lambda x: x[0]):
        k = len(list(group))
        ranks += [len(ranks) + (k + 1) / 2] * k
    plus = sum(r for r, (_, x) in zip(ranks, d) if x > 0)
    sums = [sum(r for r, s in zip(ranks, signs) if s) for signs in itertools.product((0, 1), repeat=len(ranks))]
    low, high = sum(s <= plus for s in sums), sum(s >= plus for s in sums)
    return len(ranks), plus, sum(ranks) - plus, min(1.0, 2 * min(low, high) / len(sums))


def test_signed_rank_is_all_sign_patterns(spark):
    rng = random.Random(4)
    groups = {f"g{n}-{i}": [rng.randint(-4, 5) + (rng.choice([0, 0.5]) if i else 0) for _ in range(n)] for n in range(1, 13) for i in range(3)}
    groups["zeros"] = [0, 0, 0]
    rows = [(k, 10.0, 10.0 + d) for k, ds in groups.items() for d in ds]
    df = spark.createDataFrame(rows + [("g1-0", None, 1.0), ("g1-0", 1.0, float("nan")), (None, 1.0, 2.0)], "destination_id string, pre double, post double")
    got = {r.destination_id: r for r in signed_rank(df).collect()}
    assert len(got) == len(groups) + 1
    for k, ds in groups.items():
        n, plus, minus, p = brute(ds)
        assert (got[k].n, got[k].w_plus, got[k].w_minus) == (n, plus, minus) and abs(got[k].p_value - p) < 1e-12
    assert signed_rank(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [16, 20])
def test_normal_tail_comes_near_the_exact_one(spark, n):
    rng = random.Random(n)
    rows = [("x", 0.0, rng.gauss(0.4, 1)) for _ in range(n)]
    df = spark.createDataFrame(rows, "destination_id string, pre double, post double")
    exact, tail = signed_rank(df, exact=20).first(), signed_rank(df, exact=5).first()
    assert exact.z == tail.z and abs(exact.p_value - tail.p_value) < 0.03
