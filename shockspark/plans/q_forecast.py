"""Catalogue entries: forecasts, accuracy, stitching, what-if and recovery (SURVEY
M1-M4, M6-M9, U1, U2, K4, S8, X11, X14, X16)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from shockspark.operators import forecast as FC
from shockspark.operators import kpis as KP
from shockspark.operators import recovery as RC
from shockspark.operators import shock as S
from shockspark.operators import trend_breaks as TB
from shockspark.operators.arma import seasonal_arma_forecast
from shockspark.operators.bootstrap import NAMES, trend_season_bootstrap
from shockspark.plans.catalog import register
from shockspark.plans.oracle_forecast import accuracy_sql, crisis_pair_sql, dense_sql, seasonal_ar_sql, seasonal_arma_sql, trend_breaks_sql, trend_season_sql
from shockspark.plans.oracle_shock import resilience_cte, shock_cte
from shockspark.plans.q_series import CHG_SQL
from shockspark.plans.q_shock import W
from shockspark.plans.sqlkit import cols
from shockspark.session import cut_lineage, scratch_path, session_cache
from shockspark.sources import fixtures as fx
from shockspark.sources import loaders as L
from shockspark.sources import sinks as K
from shockspark.sources.fixture_sql import with_fixtures

CRISIS_START = "1998-06-01"
DEST = ("destination_id",)
NATIONAL = ()


_PREPARED: dict[tuple, object] = session_cache()


def _prep(spark, sf_dir, keys):
    """Prepared series (densified, split), checkpointed once per session: the models
    and the accuracy read it several times."""
    k = (spark.sparkContext.applicationId, sf_dir, tuple(keys))
    if k not in _PREPARED:
        _PREPARED[k] = cut_lineage(FC.prepare(fx.daily_metrics(spark, sf_dir), keys))
    p = _PREPARED[k]
    return p.filter(~F.col("is_test")), p.filter(F.col("is_test"))


FC_COLS_D = cols("destination_id", "metric", "model", "date", "forecast:d", "lower:d", "upper:d")
FC_COLS_N = cols("metric", "model", "date", "forecast:d", "lower:d", "upper:d")


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@register("m1_trend_season_forecast", with_fixtures(dense_sql(True) + "," + trend_season_sql(True),
                                                    f"SELECT {FC_COLS_D} FROM fc"))
def m1_trend_season_forecast(spark, sf_dir):
    """M1: trend + weekly season forecast, 90 days after the train part, per destination x metric."""
    tr, _ = _prep(spark, sf_dir, DEST)
    return FC.trend_season_forecast(tr, DEST)


CRISIS_DAYS = ("1998-06-01", "1998-06-30")
_BREAKS_SQL = trend_breaks_sql(True, TB.BREAKS, TB.BEND, CRISIS_DAYS)
_FC_COLS_4 = cols("destination_id", "metric", "model", "date", "round(forecast, 4) AS forecast:d", "round(lower, 4) AS lower:d", "round(upper, 4) AS upper:d")


@register("m1_trend_breaks_forecast", _recursive(with_fixtures(dense_sql(True) + "," + _BREAKS_SQL, f"SELECT {_FC_COLS_4} FROM tb")))
def m1_trend_breaks_forecast(spark, sf_dir):
    """M1: trend with breaks, crisis days and weekly season per destination x metric, with a band
    that widens with the horizon (values to 4 places)."""
    tr, _ = _prep(spark, sf_dir, DEST)
    found = TB.trend_breaks_forecast(tr, DEST, crises=[CRISIS_DAYS])
    return found.select("destination_id", "metric", "model", "date", *[F.round(c, 4).alias(c) for c in ("forecast", "lower", "upper")])


@register("m1_breaks_accuracy", _recursive(with_fixtures(dense_sql(True) + "," + trend_season_sql(True) + "," + _BREAKS_SQL + """,
pair AS (SELECT * FROM tb UNION ALL BY NAME SELECT * FROM fc)""", """
SELECT metric, model, COUNT(*) AS n, round(round(AVG(abs(value - forecast)), 4), 6) AS mae,
  round(round(AVG(abs((value - forecast) / value)) FILTER (WHERE abs(value) > 1e-8) * 100, 4), 6) AS mape,
  round(AVG(CAST(value BETWEEN lower AND upper AS DOUBLE)), 6) AS covered
FROM pair JOIN te USING (destination_id, metric, date) GROUP BY metric, model""")))
def m1_breaks_accuracy(spark, sf_dir):
    """M1 + M4: the held-out days of all series under the single line and the trend with breaks."""
    tr, te = _prep(spark, sf_dir, DEST)
    both = TB.trend_breaks_forecast(tr, DEST, crises=[CRISIS_DAYS]).unionByName(FC.trend_season_forecast(tr, DEST))
    met = both.join(te.select(*DEST, "metric", "date", "value"), [*DEST, "metric", "date"])
    off = F.abs(F.col("value") - F.col("forecast"))
    return met.groupBy("metric", "model").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(off), 4).alias("mae"), F.round(F.avg(F.when(F.abs("value") > 1e-8, off / F.abs("value"))) * 100, 4).alias("mape"),
        F.avg(F.col("value").between(F.col("lower"), F.col("upper")).cast("double")).alias("covered"))


@register("m1_bootstrap_intervals", with_fixtures(dense_sql(True) + "," + trend_season_sql(True, horizon=28) + """,
rs AS (SELECT destination_id, metric, list(r - season ORDER BY t) AS rs FROM fc_res JOIN fc_seas USING (destination_id, metric, dow) GROUP BY 1, 2),
ends AS (SELECT destination_id, metric, MAX(date) AS train_end FROM tr GROUP BY 1, 2),
dr AS (SELECT destination_id, metric, date, forecast, rs, date_diff('day', train_end, date) AS h, b, least(len(rs), 7) AS m
  FROM fc JOIN rs USING (destination_id, metric) JOIN ends USING (destination_id, metric), range(1, 201) u(b)),
sa AS (SELECT destination_id, metric, date, forecast, forecast + rs[1 + (h - 1) % 7 % m
    + ('0x' || substr(md5(concat_ws('/', destination_id, metric, b, (h - 1) // 7)), 1, 15))::bigint % (len(rs) - m + 1)] AS x FROM dr)""", """
SELECT destination_id, metric, date, round(round(MIN(forecast), 4), 6) AS forecast,
  round(round(quantile_cont(x, 0.025), 4), 6) AS lower_95, round(round(quantile_cont(x, 0.1), 4), 6) AS lower_80,
  round(round(quantile_cont(x, 0.9), 4), 6) AS upper_80, round(round(quantile_cont(x, 0.975), 4), 6) AS upper_95
FROM sa GROUP BY destination_id, metric, date"""))
def m1_bootstrap_intervals(spark, sf_dir):
    """M1 + bootstrap (the 80 % and 95 % intervals of 200 keyed draws of weekly residual blocks), four
    weeks per destination x metric (values to 4 places)."""
    tr, _ = _prep(spark, sf_dir, DEST)
    found = trend_season_bootstrap(tr, DEST, 28)
    return found.select("destination_id", "metric", "date", *[F.round(c, 4).alias(c) for c in ("forecast", *NAMES)])


ACC_COLS_D = cols("destination_id", "metric", "model", "mae:d", "rmse:d", "mape:d", "mase:d", "mase_ref:d", "n")


@register("m4_accuracy_trend_season", with_fixtures(
    dense_sql(True) + "," + trend_season_sql(True) + "," + accuracy_sql(True), f"SELECT {ACC_COLS_D} FROM acc"))
def m4_accuracy_trend_season(spark, sf_dir):
    """M4: hold-out MAE / RMSE / MAPE / MASE (and the reference's 7th-order MASE) of M1."""
    tr, te = _prep(spark, sf_dir, DEST)
    return FC.accuracy(FC.trend_season_forecast(tr, DEST), te, FC.train_scales(tr, DEST), DEST)


@register("m3_seasonal_ar_forecast", _recursive(with_fixtures(dense_sql(True) + "," + seasonal_ar_sql(True), f"SELECT {FC_COLS_D} FROM ar")))
def m3_seasonal_ar_forecast(spark, sf_dir):
    """M3: seasonal AR(1)x(1)_7 per destination x metric (normal equations, recursion in the JVM)."""
    tr, _ = _prep(spark, sf_dir, DEST)
    return FC.seasonal_ar_forecast(tr, DEST)


_ARMA_COLS = cols("destination_id", "metric", "model", "date", "round(forecast, 4) AS forecast:d", "round(lower, 4) AS lower:d", "round(upper, 4) AS upper:d")


@register("m3_seasonal_arma_forecast", _recursive(with_fixtures(dense_sql(True) + "," + seasonal_arma_sql(True), f"SELECT {_ARMA_COLS} FROM sa")))
def m3_seasonal_arma_forecast(spark, sf_dir):
    """M3: seasonal ARMA (1,0,1)(1,0,1)_7 per destination x metric by two regressions, with a band
    that widens with the horizon (values to 4 places)."""
    tr, _ = _prep(spark, sf_dir, DEST)
    found = seasonal_arma_forecast(tr, DEST)
    return found.select("destination_id", "metric", "model", "date", *[F.round(c, 4).alias(c) for c in ("forecast", "lower", "upper")])


@register("m3_band_coverage", _recursive(with_fixtures(dense_sql(True) + "," + seasonal_arma_sql(True, horizon=30), """
SELECT sa.metric, COUNT(*) AS n, round(AVG(CAST(value BETWEEN lower AND upper AS DOUBLE)), 6) AS covered,
  round(round(AVG(upper - lower) FILTER (WHERE date_diff('day', last_day, sa.date) <= 7), 3), 6) AS width_week_1,
  round(round(AVG(upper - lower) FILTER (WHERE date_diff('day', last_day, sa.date) > 23), 3), 6) AS width_week_4
FROM sa JOIN te USING (destination_id, metric, date) JOIN (SELECT destination_id, metric, MAX(date) AS last_day FROM tr GROUP BY ALL) USING (destination_id, metric)
GROUP BY sa.metric""")))
def m3_band_coverage(spark, sf_dir):
    """M3 + M4: share of the held-out days inside the 80 % band, and its width in the first and
    the last week."""
    tr, te = _prep(spark, sf_dir, DEST)
    sk = [*DEST, "metric"]
    ends = tr.groupBy(*sk).agg(F.max("date").alias("last_day"))
    both = seasonal_arma_forecast(tr, DEST, 30).join(te.select(*sk, "date", "value"), [*sk, "date"]).join(ends, sk)
    ahead, width = F.datediff("date", "last_day"), F.col("upper") - F.col("lower")
    return both.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("value").between(F.col("lower"), F.col("upper")).cast("double")).alias("covered"),
                                      F.round(F.avg(F.when(ahead <= 7, width)), 3).alias("width_week_1"),
                                      F.round(F.avg(F.when(ahead > 23, width)), 3).alias("width_week_4"))


LINEAR_MODELS = ("trend_season", "seasonal_ar")
TREES = ("gbt_lags",)
_PIPELINES: dict[tuple, dict] = session_cache()


def _pipeline(spark, sf_dir, models):
    """National M6 run of some models, built once per session (the tree model is fitted
    when the plan is built; M2 and its accuracy share it)."""
    k = (spark.sparkContext.applicationId, sf_dir, models)
    if k not in _PIPELINES:
        _PIPELINES[k] = FC.forecast_pipeline(fx.daily_metrics(spark, sf_dir), NATIONAL, models=models)
    return _PIPELINES[k]


@register("m2_gbt_lag_forecast")
def m2_gbt_lag_forecast(spark, sf_dir):
    """M2: gradient-boosted trees on lag features, direct over the horizon (national series, as the reference)."""
    return _pipeline(spark, sf_dir, TREES)["forecast_dataset"]


@register("m6_tree_accuracy")
def m6_tree_accuracy(spark, sf_dir):
    """M6 + M4: hold-out accuracy of the tree model for the four metrics."""
    return _pipeline(spark, sf_dir, TREES)["forecast_accuracy"]


BOTH_SQL = dense_sql(False) + "," + trend_season_sql(False) + "," + seasonal_ar_sql(False) + """,
stacked AS (SELECT metric, model, date, forecast, lower, upper FROM fc UNION ALL SELECT metric, model, date, forecast, lower, upper FROM ar)"""


@register("m6_u2_forecast_dataset", _recursive(with_fixtures(BOTH_SQL, f"SELECT {FC_COLS_N} FROM stacked")))
def m6_u2_forecast_dataset(spark, sf_dir):
    """M6 + U2: national forecasts of the trend and the autoregressive model for the four metrics, stacked (the trees: M2)."""
    return _pipeline(spark, sf_dir, LINEAR_MODELS)["forecast_dataset"]


@register("m6_forecast_accuracy", _recursive(with_fixtures(
    BOTH_SQL + "," + accuracy_sql(False, "stacked"), f"SELECT {cols('metric', 'model', 'mae:d', 'rmse:d', 'mape:d', 'mase:d', 'mase_ref:d', 'n')} FROM acc")))
def m6_forecast_accuracy(spark, sf_dir):
    """M6 + M4: hold-out accuracy of both for the four metrics."""
    return _pipeline(spark, sf_dir, LINEAR_MODELS)["forecast_accuracy"]


@register("j9_forecast_actual_join", with_fixtures(dense_sql(True) + "," + trend_season_sql(True), """
SELECT fc.destination_id, fc.metric, fc.date, round(fc.forecast, 6) AS forecast, round(te.value, 6) AS y
FROM fc JOIN te ON fc.destination_id = te.destination_id AND fc.metric = te.metric AND fc.date = te.date"""))
def j9_forecast_actual_join(spark, sf_dir):
    """Forecast and actual paired by (series, date)."""
    tr, te = _prep(spark, sf_dir, DEST)
    return FC.paired(FC.trend_season_forecast(tr, DEST), te, DEST).select("destination_id", "metric", "date", "forecast", "y")


STITCH_SQL = dense_sql(False) + "," + trend_season_sql(False) + """,
st AS (SELECT metric, model, MIN(date) AS fs FROM fc GROUP BY 1, 2),
hh AS (SELECT d.metric, st.model, d.date, d.value FROM dense d JOIN st ON d.metric = st.metric WHERE d.date < st.fs AND d.value IS NOT NULL),
lh AS (SELECT metric, model, MAX(date) AS last FROM hh GROUP BY 1, 2),
stitched AS (SELECT hh.metric, hh.model, hh.date, hh.value AS historical, CASE WHEN hh.date = lh.last THEN hh.value END AS forecast,
    CAST(NULL AS DOUBLE) AS upper, CAST(NULL AS DOUBLE) AS lower FROM hh JOIN lh ON hh.metric = lh.metric AND hh.model = lh.model
  UNION ALL SELECT fc.metric, fc.model, fc.date, CAST(NULL AS DOUBLE), fc.forecast, fc.upper, fc.lower FROM fc
    JOIN st ON fc.metric = st.metric AND fc.model = st.model WHERE fc.date <= CAST(st.fs + 30 AS DATE))"""


def _stitched(spark, sf_dir):
    tr, _ = _prep(spark, sf_dir, NATIONAL)
    fc = FC.trend_season_forecast(tr, NATIONAL)
    hist = FC.prepare(fx.daily_metrics(spark, sf_dir), NATIONAL).select("metric", "date", "value")
    return FC.history_with_forecast(hist, fc, 30)


@register("u1_history_forecast_stitch", with_fixtures(STITCH_SQL, f"""
SELECT {cols('metric', 'model', 'date', 'historical:d', 'forecast:d', 'upper:d', 'lower:d')} FROM stitched"""))
def u1_history_forecast_stitch(spark, sf_dir):
    """History before the forecast start + 30 forecast days, last history point bridged."""
    return _stitched(spark, sf_dir)


SCENARIOS = [dict(FC.WHAT_IF_DEFAULT),
             {"demand_growth": 10.0, "price_elasticity": 0.9, "crisis_severity": 0.8, "travel_restrictions": 20.0,
              "seasonality_weight": 1.1}]


def _wf_sql(i, s):
    mult = (f"(1 + {s['demand_growth']} / 100) * (1 - {s['crisis_severity']} * 0.4) * "
            f"(1 - {s['travel_restrictions']} * 0.3 / 100) * {s['seasonality_weight']} * "
            f"(CASE WHEN metric = 'adr' THEN {s['price_elasticity']} ELSE 1.0 END)")
    return (f"SELECT {i} AS scenario, metric, model, date, round(historical, 6) AS historical, "
            f"round(forecast * ({mult}), 6) AS forecast, "
            f"round(CASE WHEN forecast IS NOT NULL THEN upper * ({mult}) END, 6) AS upper, "
            f"round(CASE WHEN forecast IS NOT NULL THEN lower * ({mult}) END, 6) AS lower FROM stitched")


@register("m9_what_if", with_fixtures(STITCH_SQL, "\nUNION ALL ".join(
    _wf_sql(i, {k: float(v) for k, v in s.items()}) for i, s in enumerate(SCENARIOS))))
def m9_what_if(spark, sf_dir):
    """M9: what-if multipliers for two scenarios applied to the stitched forecast."""
    return FC.what_if(_stitched(spark, sf_dir), SCENARIOS)


def _recovery_sql(aggregate: bool, after_trough: bool = False) -> str:
    v = "CAST(SUM(bookings) AS DOUBLE)" if aggregate else "CAST(bookings AS DOUBLE)"
    grp = "GROUP BY destination_id, date" if aggregate else ""
    s = f"DATE '{CRISIS_START}'"
    return f"""
g AS (SELECT destination_id, date, {v} AS v FROM daily_metrics WHERE date >= DATE '1998-05-02' {grp}),
st0 AS (SELECT destination_id, AVG(v) FILTER (WHERE date < {s}) AS pre_mean, AVG(v) FILTER (WHERE date >= {s}) AS post_mean,
  MIN(v) FILTER (WHERE date >= {s}) AS trough_level, COUNT(*) FILTER (WHERE date >= {s}) AS n_post FROM g GROUP BY 1),
st AS (SELECT *, CASE WHEN pre_mean IS NULL OR pre_mean <= 0 THEN post_mean ELSE pre_mean END AS baseline_level FROM st0
  WHERE n_post > 0),
st2 AS (SELECT *, baseline_level * 0.5 + trough_level * 0.5 AS t50, baseline_level * 0.9 + trough_level * (1 - 0.9) AS t90,
  baseline_level * 1.0 + trough_level * (1 - 1.0) AS t100 FROM st WHERE baseline_level > 0),
td AS (SELECT g.destination_id, MIN(g.date) AS trough_date FROM g JOIN st2 ON g.destination_id = st2.destination_id
  WHERE g.date >= {s} AND g.v = st2.trough_level GROUP BY 1),
fr AS (SELECT g.destination_id, MIN(g.date) FILTER (WHERE g.v >= t50) AS r50, MIN(g.date) FILTER (WHERE g.v >= t90) AS r90,
  MIN(g.date) FILTER (WHERE g.v >= t100) AS r100 FROM g JOIN st2 ON g.destination_id = st2.destination_id
  JOIN td ON g.destination_id = td.destination_id WHERE g.date >= {s} {"AND g.date >= td.trough_date" if after_trough else ""} GROUP BY 1),
rec AS (SELECT st2.destination_id, {s} AS crisis_start, baseline_level, trough_level, td.trough_date,
  fr.r50 AS recovery_50_date, fr.r90 AS recovery_90_date, fr.r100 AS recovery_100_date,
  CAST(date_diff('day', {s}, fr.r50) AS INTEGER) AS estimated_days_to_50,
  CAST(date_diff('day', {s}, fr.r90) AS INTEGER) AS estimated_days_to_90,
  CAST(date_diff('day', {s}, fr.r100) AS INTEGER) AS estimated_days_to_100
  FROM st2 JOIN td ON st2.destination_id = td.destination_id LEFT JOIN fr ON st2.destination_id = fr.destination_id)"""


REC_COLS = cols("destination_id", "crisis_start", "baseline_level:d", "trough_level:d", "trough_date", "recovery_50_date",
                "recovery_90_date", "recovery_100_date", "estimated_days_to_50", "estimated_days_to_90",
                "estimated_days_to_100")


@register("m7_recovery_timeline", with_fixtures(_recovery_sql(True), f"SELECT {REC_COLS} FROM rec"))
def m7_recovery_timeline(spark, sf_dir):
    """Recovery timeline per destination on the (destination, date) aggregate."""
    return RC.recovery_timeline(fx.daily_metrics(spark, sf_dir), CRISIS_START)


@register("m7_recovery_timeline_rows", with_fixtures(_recovery_sql(False), f"SELECT {REC_COLS} FROM rec"))
def m7_recovery_timeline_rows(spark, sf_dir):
    """M7 (reference grain): recovery timeline on the raw fact rows."""
    return RC.recovery_timeline(fx.daily_metrics(spark, sf_dir), CRISIS_START, aggregate_first=False)


@register("m8_recovery_curve", with_fixtures(f"""
st AS (SELECT destination_id, AVG(bookings) FILTER (WHERE date < DATE '{CRISIS_START}') AS b,
  CAST(MIN(bookings) FILTER (WHERE date >= DATE '{CRISIS_START}') AS DOUBLE) AS tr,
  COUNT(*) FILTER (WHERE date >= DATE '{CRISIS_START}') AS n FROM daily_metrics GROUP BY 1),
k AS (SELECT *, CASE WHEN n < 14 THEN 0.03 ELSE 0.05 END AS k FROM st WHERE b IS NOT NULL AND n > 0 AND b > 0)""", f"""
SELECT destination_id, CAST(DATE '{CRISIS_START}' + CAST(d AS INTEGER) AS DATE) AS date,
  round(GREATEST(tr + (b - tr) * (1.0 - exp(-k * d)), 0.0), 6) AS recovery_forecast, CAST(d AS INTEGER) AS days_since_crisis
FROM k, unnest(generate_series(0, 89)) AS u(d)"""))
def m8_recovery_curve(spark, sf_dir):
    """M8: exponential recovery curve for 90 days after the crisis start."""
    return RC.recovery_curve(fx.daily_metrics(spark, sf_dir), CRISIS_START)


def _forecast_outputs(spark, sf_dir) -> str:
    """K4: forecast dataset, accuracy and recovery timeline written as CSV."""
    root = scratch_path(spark, "forecast-out")
    tr, te = _prep(spark, sf_dir, NATIONAL)
    fc = FC.trend_season_forecast(tr, NATIONAL)
    acc = FC.accuracy(fc, te, FC.train_scales(tr, NATIONAL), NATIONAL)
    K.write_csv(fc.select("date", "metric", "model", "forecast", "lower", "upper"),
                os.path.join(root, "forecast_dataset"))
    K.write_csv(acc.select("metric", "model", "mae", "rmse", "mape", "mase", "n"), os.path.join(root, "forecast_accuracy"))
    K.write_csv(RC.recovery_timeline(fx.daily_metrics(spark, sf_dir), CRISIS_START),
                os.path.join(root, "crisis_recovery_timeline"))
    return root


@register("k4_s8_forecast_csv", with_fixtures(dense_sql(False) + "," + trend_season_sql(False),
                                              f"SELECT {cols('date', 'metric', 'model', 'forecast:d', 'lower:d', 'upper:d')} FROM fc"))
def k4_s8_forecast_csv(spark, sf_dir):
    """K4 + S8: forecast dataset written as CSV and loaded back."""
    return L.load_forecast_data(spark, _forecast_outputs(spark, sf_dir))["forecast_dataset"]


@register("k4_s8_accuracy_csv", with_fixtures(dense_sql(False) + "," + trend_season_sql(False) + "," + accuracy_sql(False),
                                              f"SELECT {cols('metric', 'model', 'mae:d', 'rmse:d', 'mape:d', 'mase:d', 'n')} FROM acc"))
def k4_s8_accuracy_csv(spark, sf_dir):
    """K4 + S8: forecast accuracy written as CSV and loaded back."""
    return L.load_forecast_data(spark, _forecast_outputs(spark, sf_dir))["forecast_accuracy"]


@register("k4_s8_recovery_csv", with_fixtures(_recovery_sql(True), f"SELECT {REC_COLS} FROM rec"))
def k4_s8_recovery_csv(spark, sf_dir):
    """K4 + S8: recovery timeline written as CSV and loaded back."""
    return L.load_forecast_data(spark, _forecast_outputs(spark, sf_dir))["crisis_recovery_timeline"]


@register("x11_directional_accuracy", with_fixtures(dense_sql(False) + "," + trend_season_sql(False) + """,
j AS (SELECT f.metric, f.model, f.date, t.value AS y, f.forecast FROM fc f JOIN te t ON f.metric = t.metric AND f.date = t.date),
j2 AS (SELECT *, y - LAG(y) OVER w AS dy, forecast - LAG(forecast) OVER w AS df FROM j WINDOW w AS (PARTITION BY metric, model ORDER BY date))""", """
SELECT metric, model, round(AVG(CASE WHEN sign(dy) = sign(df) THEN 1.0 ELSE 0.0 END), 6) AS directional_accuracy, COUNT(*) AS n
FROM j2 WHERE dy IS NOT NULL GROUP BY 1, 2"""))
def x11_directional_accuracy(spark, sf_dir):
    """X11 (documented extra): directional accuracy of the national M1 forecasts."""
    tr, te = _prep(spark, sf_dir, NATIONAL)
    return FC.directional_accuracy(FC.trend_season_forecast(tr, NATIONAL), te, NATIONAL)


@register("x16_crisis_vs_no_crisis", with_fixtures(dense_sql(True) + "," + crisis_pair_sql(CRISIS_START), """
SELECT * FROM x16"""))
def x16_crisis_vs_no_crisis(spark, sf_dir):
    """X16 (documented extra): forecasts fitted on pre-crisis and on all days, side by side."""
    return FC.crisis_vs_no_crisis(fx.daily_metrics(spark, sf_dir), CRISIS_START, DEST)


@register("x14_drilldown", with_fixtures(shock_cte(W) + ",\n" + resilience_cte() + "," + CHG_SQL + """,
co AS (SELECT destination_id, CORR(search_demand, bookings) AS pearson_r FROM daily_metrics
  WHERE search_demand IS NOT NULL AND search_demand > 0 GROUP BY 1 HAVING COUNT(*) >= 10)""", f"""
SELECT {cols('d.destination_id AS destination_id', 'd.destination_name AS destination_name', 'd.region AS region',
             'ch.bookings_change_pct AS bookings_change_pct:d', 'ch.cancellations_change_pct AS cancellations_change_pct:d',
             'ch.adr_change_pct AS adr_change_pct:d', 'ch.room_nights_change_pct AS room_nights_change_pct:d',
             'ch.revpar_change_pct AS revpar_change_pct:d', 'res.resilience_score AS resilience_score:d',
             'co.pearson_r AS pearson_r:d')}
FROM destinations d JOIN ch ON d.destination_id = ch.destination_id LEFT JOIN res ON d.destination_id = res.destination_id
LEFT JOIN co ON d.destination_id = co.destination_id"""))
def x14_drilldown(spark, sf_dir):
    """X14 (documented extra): destination drill-down table."""
    fact = fx.daily_metrics(spark, sf_dir)
    ch = KP.baseline_changes(fact, W)
    res = S.resilience_scores(S.shock_metrics(fact, W)).select("destination_id", "resilience_score")
    co = S.correlation_by_destination(fact).select("destination_id", "pearson_r")
    d = fx.destinations(spark, sf_dir)
    return d.join(ch, "destination_id").join(res, "destination_id", "left").join(co, "destination_id", "left").select(
        "destination_id", "destination_name", "region", "bookings_change_pct", "cancellations_change_pct",
        "adr_change_pct", "room_nights_change_pct", "revpar_change_pct", "resilience_score", "pearson_r")


@register("m7_recovery_after_trough", with_fixtures(_recovery_sql(True, after_trough=True), f"SELECT {REC_COLS} FROM rec"))
def m7_recovery_after_trough(spark, sf_dir):
    """M7 option: recovery crossings searched from the trough date on."""
    return RC.recovery_timeline(fx.daily_metrics(spark, sf_dir), CRISIS_START, mode="after_trough")
