"""Bootstrap intervals of forecasts: moving blocks of residuals, resampled by keyed draws.

For each draw, the horizon is filled with blocks of a week of consecutive residuals (weekly
dependence inside a block is kept); the interval at a step is a quantile over the draws of
forecast plus residual.  A block's first residual is picked by a hash of series, draw and
block number, so the result is the same on any partitioning and in any order, and a lost
task draws the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockspark.operators.forecast import HORIZON_DAYS, _sk, fit_trend_season, predict_trend_season

BLOCK_DAYS = 7
DRAWS = 200
LEVELS = (0.025, 0.1, 0.9, 0.975)
NAMES = ("lower_95", "lower_80", "upper_80", "upper_95")


def bootstrap_intervals(residuals: DataFrame, forecast: DataFrame, keys=("destination_id",), draws: int = DRAWS, block: int = BLOCK_DAYS) -> DataFrame:
    """(keys, metric, date, forecast, lower_95, lower_80, upper_80, upper_95).  ``residuals``:
    keys, metric, t, r of the train days (a list per series, bounded by the calendar);
    ``forecast``: keys, metric, date, h (from 1), forecast.  A series with fewer residuals than a
    block draws blocks of what there is; without any it has no rows."""
    sk = _sk(keys)
    lists = residuals.filter(F.col("r").isNotNull()).groupBy(*sk).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("t", "r"))), lambda x: x["r"]).alias("rs"))
    drawn = forecast.join(lists, sk).withColumns({"b": F.explode(F.sequence(F.lit(1), F.lit(draws))), "m": F.least(F.size("rs"), F.lit(block))})
    number = F.floor((F.col("h") - 1) / block).cast("int")
    key = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in sk], F.col("b"), number)
    hashed = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")
    place = F.pmod(hashed, F.size("rs") - F.col("m") + 1) + F.pmod(F.col("h") - 1, F.lit(block)) % F.col("m")
    sample = drawn.select(*sk, "date", "forecast", (F.col("forecast") + F.get("rs", place.cast("int"))).alias("x"))
    out = sample.groupBy(*sk, "date").agg(F.first("forecast").alias("forecast"), F.percentile("x", F.array(*map(F.lit, LEVELS))).alias("q"))
    return out.select(*sk, "date", "forecast", *[F.col("q")[i].alias(n) for i, n in enumerate(NAMES)])


def trend_season_bootstrap(train: DataFrame, keys=("destination_id",), horizon: int = HORIZON_DAYS, draws: int = DRAWS) -> DataFrame:
    """M1's forecast with bootstrap intervals from its own residuals."""
    sk = _sk(keys)
    fit = fit_trend_season(train, keys)
    line = F.col("icpt") + F.col("slope") * F.col("t") + F.coalesce(F.try_element_at("season", F.dayofweek("date")), F.lit(0.0))
    residuals = train.join(fit.select(*sk, "icpt", "slope", "season"), sk).select(*sk, "t", (F.col("value") - line).alias("r"))
    ahead = predict_trend_season(fit, F.date_add("train_end", 1), keys, horizon).join(fit.select(*sk, "train_end"), sk)
    return bootstrap_intervals(residuals, ahead.select(*sk, "date", "forecast", F.datediff("date", "train_end").alias("h")), keys, draws)
