"""Trend with breaks on series whose course is known."""

import datetime as dt

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from shockspark.operators import forecast as FC
from shockspark.operators import trend_breaks as TB

DAY0 = dt.date(2020, 1, 1)


def series(spark, values):
    return spark.createDataFrame([("bookings", DAY0 + dt.timedelta(days=t), float(v), t) for t, v in enumerate(values)],
                                 "metric string, date date, value double, t int")


def test_a_break_is_followed_where_a_line_is_not(spark):
    rng = np.random.default_rng(5)
    course = [100 + 0.2 * t if t < 300 else 160 - 0.5 * (t - 300) for t in range(460)]
    week = [0, 5, 9, 3, -4, -8, -5]
    values = [c + week[t % 7] + rng.normal() for t, c in enumerate(course)]
    train = series(spark, values[:430])
    out, line = (rows(f, ["date"]) for f in (TB.trend_breaks_forecast(train, (), 30), FC.trend_season_forecast(train, (), 30)))
    error = [np.mean([abs(r["forecast"] - v) for r, v in zip(o, values[430:])]) for o in (out, line)]
    assert error[0] < 0.35 * error[1]
    width = [r["upper"] - r["lower"] for r in out]
    assert all(a < b for a, b in zip(width, width[1:]))


def test_crisis_days_have_their_own_level(spark):
    first, last = DAY0 + dt.timedelta(days=100), DAY0 + dt.timedelta(days=129)
    rng = np.random.default_rng(6)
    values = [50 + rng.normal() - 20 * (100 <= t < 130) for t in range(200)]
    known = TB.fit_trend_breaks(series(spark, values), (), [(first, last)]).first()
    assert abs(known.beta[-1] + 20) < 1.5
    again = (DAY0 + dt.timedelta(days=205), DAY0 + dt.timedelta(days=207))
    out = rows(TB.trend_breaks_forecast(series(spark, values), (), 10, [(first, last), again]), ["date"])
    assert all(abs(r["forecast"] - (30 if again[0] <= r["date"] <= again[1] else 50)) < 3 for r in out)


def test_short_flat_and_empty_series(spark):
    short = rows(TB.trend_breaks_forecast(series(spark, range(10)), (), 2), ["date"])
    assert [(r["forecast"], r["lower"], r["upper"]) for r in short] == [(9.0, 9 * 0.8, 9 * 1.2)] * 2
    flat = rows(TB.trend_breaks_forecast(series(spark, [3.0] * 60), (), 2), ["date"])
    assert all(abs(r[c] - 3) < 1e-9 for r in flat for c in ("forecast", "lower", "upper"))
    one = rows(TB.trend_breaks_forecast(series(spark, [3.0]), (), 1), ["date"])
    assert one[0]["forecast"] == 3.0
    assert rows(TB.trend_breaks_forecast(series(spark, [1.0]).limit(0), (), 3)) == []
    assert TB.trend_breaks_forecast(series(spark, [3.0] * 60), (), 2).filter(F.col("forecast").isNull()).isEmpty()
