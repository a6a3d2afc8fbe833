"""Least squares in the row, and the seasonal ARMA forecast on series with known answers."""

import datetime as dt

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from shockspark.functions.linear import regression, solve
from shockspark.operators import arma

DAY0 = dt.date(2020, 1, 1)


def series(spark, values, metric="bookings"):
    return spark.createDataFrame([(metric, DAY0 + dt.timedelta(days=t), float(v), t) for t, v in enumerate(values)],
                                 "metric string, date date, value double, t int")


@pytest.mark.parametrize("n", [1, 2, 5, 12])
def test_solve_is_numpys(spark, n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n + 3))
    a, b = a @ a.T, rng.normal(size=n)
    df = spark.createDataFrame([([[*map(float, r), float(v)] for r, v in zip(a, b)],)], "m array<array<double>>")
    assert np.allclose(df.select(solve(F.col("m"), n).alias("x")).first().x, np.linalg.solve(a, b))


def test_unknowns_without_a_pivot_are_left_out(spark):
    df = spark.createDataFrame([([[0.0, 0.0, 0.0], [0.0, 4.0, 8.0]],)], "m array<array<double>>")
    assert df.select(solve(F.col("m"), 2).alias("x")).first().x == [0.0, 2.0]


def test_regression_is_numpys_per_series(spark):
    rng = np.random.default_rng(3)
    data, expected = [], {}
    for k in "ab":
        x = rng.normal(size=(60, 2)) @ np.array([[1, 0.5], [0, 2]]) + 5
        y = x @ rng.normal(size=2) + 3 + rng.normal(size=60)
        data += [(k, *map(float, r), float(v)) for r, v in zip(x, y)]
        full = np.c_[np.ones(60), x]
        beta, rss = np.linalg.lstsq(full, y, rcond=None)[:2]
        expected[k] = [*beta, (rss[0] / 57) ** 0.5]
    data += [("a", None, 1.0, 1e9), ("c", None, None, 1.0)]
    df = spark.createDataFrame(data, "k string, x1 double, x2 double, y double")
    got = {r.k: r for r in regression(df, ["k"], "y", ["x1", "x2"], F.count(F.lit(1)).alias("n")).collect()}
    for k, e in expected.items():
        assert np.allclose([got[k].base, *got[k].beta, got[k].sigma], e, rtol=1e-4)
    assert got["a"].m == 60 and got["a"].n == 61 and got["c"].m == 0 and got["c"].beta is None


def test_coefficients_of_a_simulated_model_are_found(spark):
    """y = 2 + 0.6 y_1 + e + 0.5 e_1: an autoregression alone cannot have this shape."""
    rng = np.random.default_rng(1)
    e, y = rng.normal(size=6000), [5.0]
    for t in range(1, 6000):
        y.append(2 + 0.6 * y[-1] + e[t] + 0.5 * e[t - 1])
    fit = arma.fit_seasonal_arma(series(spark, y), ()).first()
    assert abs(fit.beta[0] - 0.6) < 0.06 and abs(fit.beta[3] - 0.5) < 0.06 and abs(fit.sigma - 1) < 0.05
    out = rows(arma.seasonal_arma_forecast(series(spark, y), (), 20), ["date"])
    width = [r["upper"] - r["lower"] for r in out]
    exact = [2 * arma.Z_SAR * (1 + sum((1.1 * 0.6 ** (j - 1)) ** 2 for j in range(1, h))) ** 0.5 for h in range(1, 21)]
    assert np.allclose(width, exact, rtol=0.1) and width[0] < width[1] < width[2]
    assert abs(out[-1]["forecast"] - 5) < 0.5


def test_short_constant_and_unsettled_series(spark):
    short = rows(arma.seasonal_arma_forecast(series(spark, range(40)), (), 3), ["date"])
    assert [(r["forecast"], r["lower"], r["upper"]) for r in short] == [(39.0, 39 * 0.8, 39 * 1.2)] * 3
    flat = rows(arma.seasonal_arma_forecast(series(spark, [7.0] * 100), (), 3), ["date"])
    assert all(r["forecast"] == r["lower"] == r["upper"] == 7.0 for r in flat)
    grown = rows(arma.seasonal_arma_forecast(series(spark, [1.05**t for t in range(300)]), (), 90), ["date"])
    assert all(np.isfinite([r["forecast"], r["lower"], r["upper"]]).all() for r in grown)
    assert rows(arma.seasonal_arma_forecast(series(spark, range(40)).limit(0), (), 3)) == []


def test_weekly_pattern_goes_on(spark):
    rng = np.random.default_rng(2)
    week = [10, 20, 30, 40, 30, 20, 10]
    out = rows(arma.seasonal_arma_forecast(series(spark, [week[t % 7] + rng.normal() * 0.1 for t in range(400)]), (), 21), ["date"])
    assert all(abs(r["forecast"] - week[(400 + h) % 7]) < 3 for h, r in enumerate(out))
