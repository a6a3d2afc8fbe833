"""Tail probabilities as column expressions: Student's t, the normal, and the signed-rank
statistic, in higher-order functions (no Python workers, one row at a time)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the continued fraction: enough for 1e-12 up to some 10**5 degrees of freedom.
FRACTION_STEPS = 600
SERIES_TERMS = 160
TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of a positive number: Stirling's series ten places on."""
    z = x + 10
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda s, i: s + F.ln(x + i))
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - steps


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function (Lentz's evaluation)."""
    far = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)
    d0 = 1 / far(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def step(s: Column, j: Column) -> Column:
        m = F.floor(j / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        term = F.when(j % 2 == 0, even).otherwise(odd)
        d, c = 1 / far(1 + term * s["d"]), far(1 + term / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    return F.aggregate(F.sequence(F.lit(2), F.lit(FRACTION_STEPS)), start, step, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """The regularised incomplete beta function at ``x``; ``rest`` is 1 - x, given apart so
    that it keeps its digits near 0."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(rest))
    near = x < (a + 1) / (a + b + 2)
    direct = front * _fraction(F.when(near, a).otherwise(b), F.when(near, b).otherwise(a), F.when(near, x).otherwise(rest)) / F.when(near, a).otherwise(b)
    return F.when(x <= 0, 0.0).when(rest <= 0, 1.0).when(near, direct).otherwise(1 - direct)


def student_p(t: Column, freedom: Column) -> Column:
    """Two-sided tail of Student's t; null without a degree of freedom or a statistic."""
    t2, v = t * t, freedom.cast("double")
    return F.when(v >= 1, incomplete_beta(v / 2, F.lit(0.5), v / (v + t2), t2 / (v + t2)))


def normal_p(z: Column) -> Column:
    """Two-sided tail of the standard normal: 1 - erf, by the series of positive terms."""
    x = F.least(F.abs(z) / math.sqrt(2), F.lit(6.5))
    start = F.struct(x.alias("term"), x.alias("sum"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * 2 * x * x / (2 * i + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(SERIES_TERMS)), start, step, lambda s: s["sum"])
    return F.greatest(1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * series, F.lit(0.0))


def signed_rank_p(ranks: Column, plus: Column) -> Column:
    """Exact two-sided tail of the sum of the positive ranks.  ``ranks``: twice the (mean) rank of
    every difference, whole numbers; ``plus``: twice the observed sum.  The number of sign
    patterns by sum is built up rank by rank."""
    total = F.aggregate(ranks, F.lit(0), lambda s, r: s + r)
    none = F.transform(F.sequence(F.lit(0), total), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    counts = F.aggregate(ranks, none, lambda c, r: F.transform(c, lambda v, i: v + F.when(i >= r, F.get(c, F.greatest(i - r, F.lit(0)))).otherwise(0.0)))
    upto = lambda end: F.aggregate(F.slice(counts, F.lit(1), end + 1), F.lit(0.0), lambda s, v: s + v)
    # the distribution is symmetric: sums of at least w are those of at most total - w
    least = F.least(plus, total - plus)
    return F.least(F.lit(1.0), 2 * upto(least) / F.pow(F.lit(2.0), F.size(ranks)))
