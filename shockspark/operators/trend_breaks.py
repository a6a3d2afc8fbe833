"""Trend with breaks, a crisis effect and a weekly season (SURVEY M1, Prophet's role in full).

A series' trend is a line and ``BREAKS`` hinges, spread over the first 80 % of its days, whose
slopes a penalty pulls to 0: a break's slope (per length of the series) is taken to be some
``BEND`` standard deviations of the series, and what the days tell of it counts by their noise,
half the variance of the change from week to week.  So a series of noise keeps its line, and
one that bends is followed.  Days of a crisis have a level of their own.  All of it is one
penalised regression per series, from one aggregate (``functions.linear``).  The season is the mean of what is left by day of week.  The
band holds the spread of what is left and the slope changes that may come: as many and as
large as those found, so it widens with the horizon.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shockspark.functions.linear import regression
from shockspark.operators.forecast import HORIZON_DAYS, Z80, _banded, _days_ahead, _sk

BREAKS = 6
SHARE = 0.8  # of the days, over which the breaks are spread
BEND = 0.15
LEAST_POINTS = 14
MODEL = "trend_breaks"


def _basis(u: Column, date: Column, breaks: int, crises) -> dict[str, Column]:
    """Line, hinges and crisis days."""
    inside = F.lit(False)
    for first, last in crises:
        inside = inside | date.between(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date"))
    corners = [SHARE * (i + 1) / (breaks + 1) for i in range(breaks)]
    return {"u": u, **{f"h{i}": F.greatest(u - c, F.lit(0.0)) for i, c in enumerate(corners)}, "crisis": F.coalesce(inside, F.lit(False)).cast("double")}


def _line(xs) -> Column:
    return F.expr("base + " + " + ".join(f"beta[{i}] * {x}" for i, x in enumerate(xs)))


def fit_trend_breaks(train: DataFrame, keys=("destination_id",), crises: list[tuple[dt.date | str, dt.date | str]] = (), breaks: int = BREAKS,
                     bend: float = BEND) -> DataFrame:
    """One row for each series: coefficients, season by day of week, spread and last day."""
    sk = _sk(keys)
    series = Window.partitionBy(*sk)
    t_end = F.greatest(F.max("t").over(series), F.lit(1)).cast("double")
    week = F.col("value") - F.lag("value", 7).over(series.orderBy("date"))
    rows = train.select(*sk, "date", "t", F.col("value").alias("y"), (F.col("t") / t_end).alias("u"), week.alias("week"))
    basis = _basis(F.col("u"), F.col("date"), breaks, crises)
    rows = rows.withColumns({k: v for k, v in basis.items() if k != "u"})
    xs = list(basis)
    fit = regression(rows, sk, "y", xs, F.count(F.lit(1)).alias("n"), F.max("date").alias("train_end"), F.max_by("y", "date").alias("last_value"),
                     F.greatest(F.max("t"), F.lit(1)).cast("double").alias("t_end"), (F.var_pop("week") / 2).alias("noise"),
                     penalty={x: f"coalesce(least(noise / nullif(variance, 0), 1), 1) / (m * {bend * bend!r})" for x in xs[1:-1]})
    rest = rows.join(fit.select(*sk, "beta", "base"), sk).select(*sk, F.dayofweek("date").alias("dow"), (F.col("y") - _line(xs)).alias("r"))
    # spread around the season from the days of week's own counts, means and variances
    days = rest.groupBy(*sk, "dow").agg(F.count("r").alias("k"), F.avg("r").alias("season"), F.var_pop("r").alias("v"))
    season = days.groupBy(*sk).agg(F.map_from_entries(F.collect_list(F.struct("dow", "season"))).alias("season"),
                                   F.when(F.sum("k") > 1, F.sqrt(F.sum(F.col("k") * F.col("v")) / (F.sum("k") - 1))).otherwise(0.0).alias("spread"))
    return fit.select(*sk, "n", "train_end", "last_value", "t_end", "beta", "base").join(season, sk)


def trend_breaks_forecast(train: DataFrame, keys=("destination_id",), horizon: int = HORIZON_DAYS, crises=(), breaks: int = BREAKS,
                          bend: float = BEND) -> DataFrame:
    """M1 with trend breaks and crisis days (``crises``: first and last days; they may lie in
    the horizon); fewer than ``LEAST_POINTS`` points give the last value with its 0.8 / 1.2 band."""
    fit = fit_trend_breaks(train, keys, crises, breaks, bend)
    h = _days_ahead(fit, F.date_add("train_end", 1), horizon)
    basis = _basis((F.col("t_end") + F.col("h")) / F.col("t_end"), F.col("date"), breaks, crises)
    h = h.withColumns(basis)
    f = _line(list(basis)) + F.coalesce(F.try_element_at("season", F.dayofweek("date")), F.lit(0.0))
    squares = F.aggregate(F.slice("beta", 2, breaks), F.lit(0.0), lambda s, b: s + b * b)
    to_come = squares / breaks * (breaks / SHARE) * F.pow(F.col("h") / F.col("t_end"), F.lit(3)) / 3
    return _banded(h, _sk(keys), MODEL, F.col("n") < LEAST_POINTS, f, F.sqrt(F.col("spread") * F.col("spread") + to_come) * Z80)
