"""Least squares for many series at once: the normal equations of a series are sums of one
aggregate, and are solved in the row by elimination with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RIDGE = 1e-6  # share of its own variance that is added to each regressor's


def solve(matrix: Column, n: int) -> Column:
    """The solution of ``n`` equations given as rows of ``n`` coefficients and the right side
    (symmetric, positive semidefinite): one elimination step for each unknown; an unknown
    whose pivot is not positive is left out (0)."""

    def eliminate(rows: Column, k: Column) -> Column:
        pivot = F.get(rows, k)
        p = F.get(pivot, k)
        others = F.transform(rows, lambda row, i: F.when(i == k, row).otherwise(
            F.zip_with(row, pivot, lambda a, b: a - F.get(row, k) / p * b)))
        return F.when(p > 0, others).otherwise(rows)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), matrix, eliminate)
    return F.transform(done, lambda row, i: F.when(F.get(row, i) > 0, F.get(row, F.lit(n)) / F.get(row, i)).otherwise(F.lit(0.0)))


def regression(rows: DataFrame, keys: list[str], y: str, xs: list[str], *more: Column, penalty: dict[str, str] | None = None) -> DataFrame:
    """(keys, m, mean, beta, base, sigma, variance, more): regression of ``y`` on ``xs`` with an
    intercept for each series over the rows where none of them is missing.  ``more``
    aggregates see all rows.  ``penalty``, SQL over m, mean, variance and ``more``, is added
    to the variance of a regressor (it pulls the coefficient to 0); beside it each regressor's
    variance grows by RIDGE."""
    # as SQL text: some hundred terms are much faster to build than as column objects
    n = len(xs)
    pairs = [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
    kept = rows.withColumn("_whole", F.expr(" AND ".join(f"{c} IS NOT NULL" for c in [y, *xs])))
    sums = kept.groupBy(*keys).agg(*map(F.expr, [
        "count_if(_whole) AS m", f"avg({y}) FILTER (WHERE _whole) AS mean", f"var_pop({y}) FILTER (WHERE _whole) AS variance",
        *[f"avg({x}) FILTER (WHERE _whole) AS m_{x}" for x in xs], *[f"covar_pop({x}, {y}) FILTER (WHERE _whole) AS y_{x}" for x in xs],
        *[f"covar_pop({a}, {b}) FILTER (WHERE _whole) AS {a}_{b}" for a, b in pairs]]), *more)
    added = sums.columns[len(keys) + 3 + 2 * n + len(pairs):]

    def cell(a: str, b: str) -> str:
        known = f"{a}_{b}" if (a, b) in pairs else f"{b}_{a}"
        return f"{known} * {1 + RIDGE!r}D + {(penalty or {}).get(a, '0D')}" if a == b else known

    matrix = F.expr("array(" + ", ".join("array(" + ", ".join([*(cell(a, b) for b in xs), f"y_{a}"]) + ")" for a in xs) + ")")
    fit = sums.withColumn("beta", F.when(F.col("m") > 0, solve(matrix, n)))
    fit = fit.withColumn("base", F.expr("mean - (" + " + ".join(f"beta[{i}] * m_{x}" for i, x in enumerate(xs)) + ")"))
    # residual variance: that of y, less twice the fitted covariance, plus the fit's own
    own = " + ".join(f"beta[{xs.index(a)}] * beta[{xs.index(b)}] * {a}_{b} * {1 if a == b else 2}" for a, b in pairs)
    shared = " + ".join(f"beta[{i}] * y_{x}" for i, x in enumerate(xs))
    rest = f"greatest(variance - 2 * ({shared}) + ({own}), 0D)"
    fit = fit.withColumn("sigma", F.expr(f"if(m > {n + 1}, sqrt({rest} * m / (m - {n + 1})), 0D)"))
    return fit.select(*keys, "m", "mean", "variance", "beta", "base", "sigma", *added)
