"""Many-series forecasting with hold-out accuracy (SURVEY M1-M4, M6, M9, U1, U2, X11,
X16).

The reference fits one national series per metric with single-machine libraries that
are not available here.  The capability is rebuilt for many series at once
(key = destination x metric), in the JVM throughout; model names say what each model is:

* ``trend_season`` (M1, Prophet's role): linear trend plus a day-of-week mean of the
  residuals, 80 % band from the remaining residual spread.  All of it follows from counts,
  means, variances and covariances per (series, day of week): one group-by.
* ``seasonal_ar`` (M3, SARIMA's role): y_t = c + a y_{t-1} + b y_{t-7} + d y_{t-8} by the
  normal equations of one aggregate per series; the recursion over the horizon is an
  ``aggregate`` over a list of days.
* ``gbt_lags`` (M2, XGBoost's role): one ``pyspark.ml`` gradient-boosted tree model for all
  series, direct over the horizon: the days ahead are a feature, so forecasting is one
  ``model.transform``.
"""

from __future__ import annotations

import datetime as dt
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shockspark.functions.exprs import safe_div
from shockspark.session import cut_lineage
from shockspark.operators.series import FORECAST_METRICS, LAG_FEATURES, daily_series, densify, split_train_test

HORIZON_DAYS = 90
TEST_DAYS = 30
MIN_POINTS = 14
# The two normal quantiles of the 80 % bands, and the band of a short series.
Z80 = 1.28
Z_SAR = 1.2815515655446004
SHORT_BAND = (0.8, 1.2)
# Days ahead at which the tree model is trained; it is scored at every day of the horizon.
TRAIN_AHEAD = (1, 2, 3, 5, 7, 10, 14, 21, 30, 45, 60, 75, 90)


def _sk(keys):
    return list(keys) + ["metric"]


def _days_ahead(df: DataFrame, first: Column, horizon: int) -> DataFrame:
    """One row per day of the horizon; ``first`` is its first date."""
    return df.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("date", F.date_add(first, F.col("h") - 1))


def _banded(df: DataFrame, sk, model: str, short: Column, forecast: Column, band: Column, floor: float | None = None) -> DataFrame:
    """Forecast rows: last value with the short-series band where ``short``, else
    ``forecast`` -/+ ``band`` (the lower end not below ``floor``)."""
    last = F.col("last_value")
    f = F.when(short, last).otherwise(forecast)
    lower = f - band if floor is None else F.greatest(F.lit(floor), f - band)
    return df.select(*sk, F.lit(model).alias("model"), "date", f.alias("forecast"),
                     F.when(short, last * SHORT_BAND[0]).otherwise(lower).alias("lower"),
                     F.when(short, last * SHORT_BAND[1]).otherwise(f + band).alias("upper"))


def fit_trend_season(train: DataFrame, keys=("destination_id",)) -> DataFrame:
    """Per series: slope, level at t = 0, seasonal mean by day of week, residual spread.
    ``train`` is read once; the second group-by sees at most seven rows per series."""
    sk = _sk(keys)
    by_day = train.groupBy(*sk, F.dayofweek("date").alias("dow")).agg(
        F.count(F.lit(1)).alias("k"), F.avg("t").alias("mt"), F.avg("value").alias("mv"), F.var_pop("t").alias("tt"),
        F.covar_pop("t", "value").alias("tv"), F.var_pop("value").alias("vv"), F.max("date").alias("last"),
        F.max_by("value", "date").alias("last_value"), F.max("t").alias("t_last"))
    k = F.col("k")
    fit = by_day.groupBy(*sk).agg(
        F.sum("k").alias("n"), (F.sum(k * F.col("mt")) / F.sum("k")).alias("mean_t"), (F.sum(k * F.col("mv")) / F.sum("k")).alias("mean_v"),
        F.collect_list(F.struct("dow", "k", "mt", "mv", "tt", "tv", "vv")).alias("days"), F.max("last").alias("train_end"),
        F.max_by("last_value", "last").alias("last_value"), F.max("t_last").alias("t_end"))

    def total(term) -> Column:
        return F.aggregate("days", F.lit(0.0), lambda acc, d: acc + d["k"] * term(d))

    t, v = F.col("mean_t"), F.col("mean_v")
    s_tt = total(lambda d: d["tt"] + (d["mt"] - t) * (d["mt"] - t))
    s_tv = total(lambda d: d["tv"] + (d["mt"] - t) * (d["mv"] - v))
    fit = fit.withColumn("slope", F.when(s_tt > 0, s_tv / s_tt).otherwise(F.lit(0.0)))
    slope = F.col("slope")
    fit = fit.withColumn("icpt", v - slope * t)
    squares = total(lambda d: d["vv"] - 2 * slope * d["tv"] + slope * slope * d["tt"])
    season = F.map_from_entries(F.transform("days", lambda d: F.struct(d["dow"], d["mv"] - F.col("icpt") - slope * d["mt"])))
    return fit.select(*sk, "n", "slope", "icpt", season.alias("season"), F.when(F.col("n") > 1, F.sqrt(
        F.greatest(squares, F.lit(0.0)) / (F.col("n") - 1))).otherwise(F.lit(0.0)).alias("sigma"),
        "train_end", "last_value", F.date_sub("train_end", F.col("t_end")).alias("origin"))


def predict_trend_season(fit: DataFrame, first: Column, keys=("destination_id",), horizon: int = HORIZON_DAYS, min_points: int = 7) -> DataFrame:
    """The fitted trend and season on ``horizon`` days from ``first`` on."""
    h = _days_ahead(fit, first, horizon)
    f = (F.col("icpt") + F.col("slope") * F.datediff("date", "origin")
         + F.coalesce(F.try_element_at("season", F.dayofweek("date")), F.lit(0.0)))
    return _banded(h, _sk(keys), "trend_season", F.col("n") < min_points, f, F.col("sigma") * Z80)


def trend_season_forecast(train: DataFrame, keys=("destination_id",), horizon: int = HORIZON_DAYS,
                          min_points: int = 7) -> DataFrame:
    """M1: linear trend + day-of-week residual mean; band = 1.28 x sample std of what is
    left; fewer than ``min_points`` points -> last value with a 0.8 / 1.2 band."""
    return predict_trend_season(fit_trend_season(train, keys), F.date_add("train_end", 1), keys, horizon, min_points)


def seasonal_ar_forecast(train: DataFrame, keys=("destination_id",), horizon: int = HORIZON_DAYS,
                         min_points: int = 30) -> DataFrame:
    """M3: seasonal AR(1)x(1)_7 per series (least squares on lags 1, 7, 8); band = z(0.2) x
    residual std with four parameters; fewer than ``min_points`` points -> last value, 0.8
    / 1.2 band.  Where the three lags are collinear lag 8 is left out, where lags 1 and 7
    are, lag 1 too; a constant lag 7 leaves the mean of the days from the ninth on."""
    sk = _sk(keys)
    w = Window.partitionBy(*sk).orderBy("date")
    lags = {"a": 1, "b": 7, "c": 8}
    rows = train.withColumns({x: F.lag("value", k).over(w) for x, k in lags.items()})
    full = F.col("c").isNotNull()
    y = F.when(full, F.col("value"))
    pairs = [("a", "a"), ("b", "b"), ("c", "c"), ("a", "b"), ("a", "c"), ("b", "c")]
    moments = rows.groupBy(*sk).agg(
        F.count(F.lit(1)).alias("n"), F.max("date").alias("train_end"), F.max_by("value", "date").alias("last_value"),
        F.max_by(F.struct("value", "t"), "date")["t"].alias("t_end"), F.count(y).alias("m"), F.avg(y).alias("my"), F.var_pop(y).alias("yy"),
        *[F.avg(F.when(full, F.col(x))).alias(f"m{x}") for x in lags], *[F.covar_pop(F.when(full, F.col(x)), y).alias(f"{x}y") for x in lags],
        *[F.covar_pop(F.when(full, F.col(p)), F.when(full, F.col(q))).alias(p + q) for p, q in pairs])
    recent = train.join(moments.select(*sk, "t_end"), sk).filter(F.col("t") > F.col("t_end") - 8).groupBy(*sk).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda r: r["value"]).alias("recent"))

    def det(columns) -> Column:
        (a1, a2, a3), (b1, b2, b3), (c1, c2, c3) = [[F.col(x) for x in c] for c in columns]
        return a1 * (b2 * c3 - b3 * c2) - b1 * (a2 * c3 - a3 * c2) + c1 * (a2 * b3 - a3 * b2)

    left = [("aa", "ab", "ac"), ("ab", "bb", "bc"), ("ac", "bc", "cc")]
    right = ("ay", "by", "cy")
    # Cramer's rule on the normal equations of three lags, of lags 1 and 7, or of lag 7
    aa, bb, cc, ab, ay, by = (F.col(x) for x in ("aa", "bb", "cc", "ab", "ay", "by"))
    three, two, zero = det(left), aa * bb - ab * ab, F.lit(0.0)
    of_three = [det([right if i == j else c for j, c in enumerate(left)]) / three for i in range(3)]
    of_two = [(ay * bb - ab * by) / two, (aa * by - ab * ay) / two, zero]
    of_one = [zero, by / bb, zero]
    fit = moments.withColumns({f"w{x}": F.when(three > 1e-9 * aa * bb * cc, of_three[i]).when(two > 1e-9 * aa * bb, of_two[i])
                               .when(bb > 0, of_one[i]).otherwise(zero) for i, x in enumerate(lags)})
    fitted = sum(F.col(f"w{x}") * F.col(f"{x}y") for x in lags)
    fit = fit.withColumns({
        "base": F.col("my") - sum(F.col(f"w{x}") * F.col(f"m{x}") for x in lags),
        "sigma": F.when(F.col("m") > 4, F.sqrt(F.greatest(F.col("yy") - fitted, F.lit(0.0)) * F.col("m") / (F.col("m") - 4))).otherwise(F.lit(0.0))})
    both = fit.join(recent, sk)

    def back(path: Column, k: int) -> Column:
        return F.get(path, F.size(path) - k)

    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("recent"), lambda p, _: F.concat(p, F.array(
        F.col("base") + sum(F.col(f"w{x}") * back(p, k) for x, k in lags.items()))))
    both = both.withColumn("path", F.when(F.col("n") >= min_points, path))
    h = _days_ahead(both, F.date_add("train_end", 1), horizon)
    f = F.get("path", F.size("recent") + F.col("h") - 1)
    return _banded(h, sk, "seasonal_ar", F.col("n") < min_points, f, F.col("sigma") * Z_SAR)


def _origin_features(train: DataFrame, sk, lags) -> DataFrame:
    """Every day of a series with the values 0, ... days back that the lags name (lag 1 is
    the day itself, the last one known), the series' length and its last day."""
    w = Window.partitionBy(*sk).orderBy("date")
    whole = Window.partitionBy(*sk)
    index = F.create_map(*[F.lit(x) for i, m in enumerate(FORECAST_METRICS) for x in (m, float(i))])
    return train.select(*sk, "date", "value", F.count(F.lit(1)).over(whole).alias("n"), F.max("date").over(whole).alias("train_end"),
                        F.coalesce(F.try_element_at(index, F.col("metric")), F.lit(-1.0)).alias("metric_idx"),
                        *[F.lag("value", k - 1).over(w).alias(f"lag_{k}") for k in lags])


def gbt_lag_forecast(train: DataFrame, keys=("destination_id",), horizon: int = HORIZON_DAYS,
                     lags=LAG_FEATURES, n_trees: int = 100, depth: int = 5, step: float = 0.1,
                     seed: int = 42, max_bins: int = 64, ahead=TRAIN_AHEAD) -> DataFrame:
    """M2: gradient-boosted trees, direct over the horizon: from the lags known on a day,
    the days ahead, the weekday aimed at and the metric, the value on that later day.  One
    model for all series; non-negative; band = 1.28 x std of a series' forecasts (lower
    end not below 0); series shorter than max(lag) + 10 -> last value, 0.8 / 1.2 band."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    sk = _sk(keys)
    names = [f"lag_{k}" for k in lags]
    origins = _origin_features(train, sk, lags)
    later = train.select(*sk, F.col("date").alias("aim"), F.col("value").alias("target"))
    aimed = origins.dropna(subset=names).withColumn("h", F.explode(F.array(*[F.lit(int(d)) for d in ahead]))) \
        .withColumn("aim", F.date_add("date", F.col("h"))).join(later, [*sk, "aim"])
    inputs = [*names, "h", "weekday", "metric_idx"]
    assemble = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")
    data = cut_lineage(aimed.withColumn("weekday", F.dayofweek("aim")).select(*inputs, "target"), "gbt-train")
    gbt = GBTRegressor(featuresCol="features", labelCol="target", maxIter=n_trees, maxDepth=depth, stepSize=step, seed=seed, maxBins=max_bins)
    last = origins.filter(F.col("date") == F.col("train_end")).withColumnRenamed("value", "last_value").drop("date")
    asked = _days_ahead(last, F.date_add("train_end", 1), horizon).withColumn("weekday", F.dayofweek("date")).fillna(0.0, names)
    if data.isEmpty():
        scored = asked.withColumn("prediction", F.lit(0.0))
    else:
        scored = gbt.fit(assemble.transform(data).select("features", "target")).transform(assemble.transform(asked))
    scored = scored.withColumn("f", F.greatest(F.lit(0.0), F.col("prediction")))
    band = F.stddev_pop("f").over(Window.partitionBy(*sk)) * Z80
    return _banded(scored.withColumn("band", band), sk, "gbt_lags", F.col("n") < max(lags) + 10, F.col("f"), F.col("band"), floor=0.0)


# --- M4: accuracy ----------------------------------------------------------------------

def train_scales(train: DataFrame, keys=("destination_id",), period: int = 7) -> DataFrame:
    """MASE scales per series: mean |y_t - y_{t-7}| (seasonal naive, default) and the
    reference's mean |7th-order difference| (``np.diff(y, 7)``), NULL when the train
    part has fewer than period + 1 points or the scale is 0."""
    sk = _sk(keys)
    w = Window.partitionBy(*sk).orderBy("date")
    coef = [(-1) ** k * comb(period, k) for k in range(period + 1)]
    lagged = train.withColumns({f"_l{k}": F.lag("value", k).over(w) for k in range(1, period + 1)})
    diff_n = sum((F.col("value") if k == 0 else F.col(f"_l{k}")) * c for k, c in enumerate(coef))
    s = lagged.groupBy(*sk).agg(F.count(F.lit(1)).alias("n_train"),
                                F.avg(F.abs(F.col("value") - F.col(f"_l{period}"))).alias("_seasonal"),
                                F.avg(F.abs(diff_n)).alias("_order"))
    ok = F.col("n_train") >= period + 1
    return s.select(*sk, "n_train",
                    F.when(ok & (F.col("_seasonal") != 0), F.col("_seasonal")).alias("scale_seasonal"),
                    F.when(ok & (F.col("_order") != 0), F.col("_order")).alias("scale_order"))


def paired(forecasts: DataFrame, test: DataFrame, keys=("destination_id",)) -> DataFrame:
    """Forecasts with the actual value ``y`` of the same series and date."""
    sk = _sk(keys)
    return forecasts.join(test.select(*sk, "date", F.col("value").alias("y")), sk + ["date"])


def accuracy(forecasts: DataFrame, test: DataFrame, scales: DataFrame, keys=("destination_id",),
             eps: float = 1e-8) -> DataFrame:
    """M4: MAE, RMSE, MAPE (x100, |y| > eps only), MASE (seasonal-naive scale) and the
    reference-parity ``mase_ref`` (7th-order difference scale), n; forecast and actual
    are paired by date (inner join)."""
    sk = _sk(keys)
    j = paired(forecasts, test, keys)
    e = F.col("y") - F.col("forecast")
    big = F.abs(F.col("y")) > eps
    acc = j.groupBy(*sk, "model").agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.when(big, F.abs(e / F.col("y")))) * 100).alias("mape"), F.count(F.lit(1)).alias("n"))
    acc = acc.join(scales, sk, "left")
    return acc.select(*sk, "model", "mae", "rmse", "mape", safe_div("mae", "scale_seasonal").alias("mase"),
                      safe_div("mae", "scale_order").alias("mase_ref"), "n")


def directional_accuracy(forecasts: DataFrame, test: DataFrame, keys=("destination_id",)) -> DataFrame:
    """X11 (documented extra): share of days where forecast and actual move in the same
    direction as the day before."""
    sk = _sk(keys)
    j = paired(forecasts, test, keys)
    w = Window.partitionBy(*sk, "model").orderBy("date")
    j = j.withColumns({"dy": F.col("y") - F.lag("y").over(w), "df": F.col("forecast") - F.lag("forecast").over(w)})
    j = j.filter(F.col("dy").isNotNull())
    return j.groupBy(*sk, "model").agg(F.avg(F.when(F.signum("dy") == F.signum("df"), 1.0).otherwise(0.0))
                                       .alias("directional_accuracy"), F.count(F.lit(1)).alias("n"))


# --- M6: pipeline ------------------------------------------------------------------------

MODELS = {"trend_season": trend_season_forecast, "seasonal_ar": seasonal_ar_forecast, "gbt_lags": gbt_lag_forecast}


def prepare(fact: DataFrame, keys=("destination_id",), test_days: int = TEST_DAYS,
            min_points: int = MIN_POINTS) -> DataFrame:
    """M6 steps 1-3: daily series (adr by mean, others by sum) -> densified -> series
    with fewer than ``min_points`` days dropped -> train / test flag."""
    dense = densify(daily_series(fact, keys), keys)
    n = F.count(F.lit(1)).over(Window.partitionBy(*_sk(keys)))
    dense = dense.withColumn("_n", n).filter(F.col("_n") >= min_points).drop("_n")
    return split_train_test(dense, keys, test_days)


def forecast_pipeline(fact: DataFrame, keys=("destination_id",), models=("trend_season", "seasonal_ar"),
                      horizon: int = HORIZON_DAYS, test_days: int = TEST_DAYS,
                      materialize: bool = True) -> dict[str, DataFrame]:
    """M6: forecasts of every requested model for every (key, metric) series, stacked
    (U2), and their hold-out accuracy (M4).  The horizon starts the day after the
    train part ends, as in the reference."""
    prep = prepare(fact, keys, test_days)
    if materialize:
        # Every model and the accuracy read the prepared series several times: cut
        # the lineage once (reliable checkpoint in spark.checkpoint.dir).
        prep = cut_lineage(prep)
    train = prep.filter(~F.col("is_test"))
    test = prep.filter(F.col("is_test"))
    parts = [MODELS[m](train, keys, horizon) for m in models]
    fc = parts[0]
    for p in parts[1:]:
        fc = fc.unionByName(p)
    acc = accuracy(fc, test, train_scales(train, keys), keys)
    return {"forecast_dataset": fc, "forecast_accuracy": acc, "prepared": prep}


# --- U1 / M9: history + forecast stitch and what-if ---------------------------------------

def history_with_forecast(history: DataFrame, forecasts: DataFrame, horizon_days: int = 30,
                          keys=()) -> DataFrame:
    """Per (keys, metric, model): history before the forecast start, forecast rows up
    to start + ``horizon_days``, and the last history point bridged (its forecast =
    its historical value).  ``history`` is (keys, metric, date, value)."""
    sk = list(keys) + ["metric"]
    start = forecasts.groupBy(*sk, "model").agg(F.min("date").alias("_fs"))
    h = history.filter(F.col("value").isNotNull()).join(start, sk).filter(F.col("date") < F.col("_fs"))
    last = h.groupBy(*sk, "model").agg(F.max("date").alias("_last"))
    h = h.join(last, sk + ["model"])
    bridge = F.col("date") == F.col("_last")
    hist_rows = h.select(*sk, "model", "date", F.col("value").alias("historical"),
                         F.when(bridge, F.col("value")).alias("forecast"),
                         F.lit(None).cast("double").alias("upper"), F.lit(None).cast("double").alias("lower"))
    f = forecasts.join(start, sk + ["model"]).filter(F.col("date") <= F.date_add("_fs", horizon_days))
    f_rows = f.select(*sk, "model", "date", F.lit(None).cast("double").alias("historical"), "forecast", "upper",
                      "lower")
    return hist_rows.unionByName(f_rows)


WHAT_IF_DEFAULT = {"demand_growth": 0.0, "price_elasticity": 1.0, "crisis_severity": 0.5,
                   "travel_restrictions": 0.0, "seasonality_weight": 1.0}


def what_if(stitched: DataFrame, scenarios: list[dict] | None = None) -> DataFrame:
    """M9: scale forecast, lower and upper by (1 + g/100)(1 - 0.4 sev)(1 - 0.3 r/100) x
    season weight (x price factor for adr).  Several scenarios are applied at once by
    exploding a literal scenario list (no join)."""
    scenarios = scenarios or [dict(WHAT_IF_DEFAULT)]
    arr = F.array(*[F.struct(F.lit(i).alias("scenario"), *[F.lit(float(s.get(k, v))).alias(k)
                                                           for k, v in WHAT_IF_DEFAULT.items()])
                    for i, s in enumerate(scenarios)])
    x = stitched.withColumn("_s", F.explode(arr))
    s = lambda k: F.col(f"_s.{k}")
    mult = ((1 + s("demand_growth") / 100) * (1 - s("crisis_severity") * 0.4)
            * (1 - s("travel_restrictions") * 0.3 / 100) * s("seasonality_weight")
            * F.when(F.col("metric") == "adr", s("price_elasticity")).otherwise(F.lit(1.0)))
    keep = [c for c in stitched.columns if c not in ("forecast", "upper", "lower")]
    has_f = F.col("forecast").isNotNull()
    return x.select(s("scenario").alias("scenario"), *keep,
                    (F.col("forecast") * mult).alias("forecast"),
                    F.when(has_f, F.col("upper") * mult).alias("upper"),
                    F.when(has_f, F.col("lower") * mult).alias("lower"))


def crisis_vs_no_crisis(fact: DataFrame, crisis_start, keys=("destination_id",), horizon: int = HORIZON_DAYS) -> DataFrame:
    """X16 (documented extra): two M1 forecasts of the ``horizon`` days from the crisis
    start, side by side: fitted on the days before the crisis (no crisis) and on all
    days (crisis); a series needs days before the crisis."""
    start = crisis_start if isinstance(crisis_start, dt.date) else dt.date.fromisoformat(str(crisis_start)[:10])
    sk = _sk(keys)
    dense = cut_lineage(densify(daily_series(fact, keys), keys), "dense")

    def of(rows: DataFrame, name: str) -> DataFrame:
        found = predict_trend_season(fit_trend_season(rows, keys), F.lit(start), keys, horizon)
        return found.select(*sk, "date", *[F.col(c).alias(f"{name}_{c}") for c in ("forecast", "lower", "upper")])

    both = of(dense.filter(F.col("date") < F.lit(start)), "no_crisis").join(of(dense, "crisis"), [*sk, "date"])
    return both.withColumn("impact", F.col("crisis_forecast") - F.col("no_crisis_forecast"))
