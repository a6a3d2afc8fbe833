"""Seasonal ARMA forecasts of many series (SURVEY M3: SARIMA (1,0,1)(1,0,1) with period 7).

Hannan and Rissanen's two stages: a long autoregression gives residuals, which then stand in
for the unknown shocks in one regression on the model's own lags of values and of shocks
(lags 1, 7 and 8, the product of the short and the weekly factor).  Both regressions are
aggregates per series (``functions.linear``).  The forecast is the recursion of the model with
the known shocks and none to come; the band follows from the weights of past shocks in the
forecast error (psi weights) and so widens with the horizon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shockspark.functions.linear import regression
from shockspark.operators.forecast import HORIZON_DAYS, Z_SAR, _banded, _days_ahead, _sk

LONG_LAGS = (1, 2, 3, 7, 8, 14, 15, 21, 22)
LAGS = (1, 7, 8)
MODEL = "seasonal_arma"
LEAST_ROWS = 30  # of the second regression
WILD = 1.0  # psi weights of the last two weeks beyond it: the fitted model does not settle


def _back(path: Column, k: int) -> Column:
    return F.get(path, F.size(path) - k)


def _lagged(column: str, lags, w) -> dict[str, Column]:
    return {f"{column}{k}": F.lag(column, k).over(w) for k in lags}


def fit_seasonal_arma(train: DataFrame, keys=("destination_id",)) -> DataFrame:
    """One row for each series: coefficients (of value lags, then of shock lags), intercept,
    spread, and the last eight values and shocks.  A series too short for the second
    regression has few rows ``m``."""
    sk = _sk(keys)
    w = Window.partitionBy(*sk).orderBy("date")
    # the lags of values serve both regressions
    rows = train.select(*sk, "date", "t", F.col("value").alias("y")).withColumns(_lagged("y", LONG_LAGS, w))
    long = regression(rows, sk, "y", [f"y{k}" for k in LONG_LAGS])
    shock = F.col("y") - F.col("base") - sum(F.get("beta", F.lit(i)) * F.col(f"y{k}") for i, k in enumerate(LONG_LAGS))
    shocks = rows.join(long.select(*sk, "beta", "base"), sk).select(*sk, "date", "y", *[f"y{k}" for k in LAGS], shock.alias("e"))
    shocks = shocks.withColumns(_lagged("e", LAGS, w))
    fit = regression(shocks, sk, "y", [f"y{k}" for k in LAGS] + [f"e{k}" for k in LAGS], F.count(F.lit(1)).alias("n"), F.max("date").alias("train_end"),
                     F.max_by("y", "date").alias("last_value"))
    recent = shocks.join(fit.select(*sk, "train_end"), sk).filter(F.datediff("train_end", "date") < max(LAGS)).groupBy(*sk).agg(
        F.array_sort(F.collect_list(F.struct("date", "y", F.coalesce("e", F.lit(0.0)).alias("e")))).alias("r"))
    return fit.join(recent, sk).withColumns({"values": F.col("r.y"), "shocks": F.col("r.e")}).drop("r")


def psi_weights(beta: Column, horizon: int) -> Column:
    """The first ``horizon`` weights of past shocks in the series: 1, then by recursion."""
    theta = {k: F.get(beta, F.lit(len(LAGS) + i)) for i, k in enumerate(LAGS)}
    phi = {k: F.get(beta, F.lit(i)) for i, k in enumerate(LAGS)}

    def longer(p: Column, j: Column) -> Column:
        own = F.coalesce(*[F.when(j == k, t) for k, t in theta.items()], F.lit(0.0))
        return F.concat(p, F.array(own + sum(F.when(j >= k, c * F.get(p, F.greatest(j - k, F.lit(0)))).otherwise(F.lit(0.0)) for k, c in phi.items())))

    one = F.array(F.lit(1.0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(horizon - 1)), one, longer) if horizon > 1 else one


def predict_seasonal_arma(fit: DataFrame, keys=("destination_id",), horizon: int = HORIZON_DAYS) -> DataFrame:
    """``horizon`` days after the train part; the mean and its spread for a fitted model that
    does not settle, the last value with the 0.8 / 1.2 band for a short series."""
    fit = fit.withColumn("psi", F.when(F.col("m") >= LEAST_ROWS, psi_weights(F.col("beta"), horizon)))
    tail = F.aggregate(F.slice("psi", max(1, horizon - 13), 14), F.lit(0.0), lambda a, p: F.greatest(a, F.abs(p)))
    settled = fit.withColumn("settled", tail <= WILD)
    value = lambda p: sum(F.get("beta", F.lit(i)) * _back(p, k) for i, k in enumerate(LAGS))
    shock = lambda h: sum(F.get("beta", F.lit(len(LAGS) + i)) * F.when(h <= k, F.get("shocks", F.size("shocks") - 1 - k + h)).otherwise(F.lit(0.0))
                          for i, k in enumerate(LAGS))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("values"), lambda p, h: F.concat(p, F.array(F.col("base") + value(p) + shock(h))))
    settled = settled.withColumns({"path": F.when(F.col("settled"), path), "start": F.size("values")})
    h = _days_ahead(settled, F.date_add("train_end", 1), horizon)
    error = F.sqrt(F.aggregate(F.slice("psi", 1, F.col("h")), F.lit(0.0), lambda a, p: a + p * p))
    f = F.when(F.col("settled"), F.get("path", F.col("start") + F.col("h") - 1)).otherwise(F.col("mean"))
    band = F.when(F.col("settled"), F.col("sigma") * error).otherwise(F.sqrt("variance"))
    return _banded(h, _sk(keys), MODEL, F.col("m") < LEAST_ROWS, f, band * Z_SAR)


def seasonal_arma_forecast(train: DataFrame, keys=("destination_id",), horizon: int = HORIZON_DAYS) -> DataFrame:
    """M3: seasonal ARMA with a widening 80 % band, per series."""
    return predict_seasonal_arma(fit_seasonal_arma(train, keys), keys, horizon)
