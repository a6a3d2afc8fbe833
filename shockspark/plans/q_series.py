"""Catalogue entries: series preparation, decomposition, seasonality and the
documented rolling / calendar extras (SURVEY W4-W9, M5, X1-X6, X10, X12, X13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shockspark.operators import kpis as KP
from shockspark.operators import series as SE
from shockspark.plans.catalog import register
from shockspark.plans.sqlkit import cols
from shockspark.sources import fixtures as fx
from shockspark.sources.fixture_sql import with_fixtures

CRISIS_START = "1998-06-01"

DENSE_SQL = """
ds AS (SELECT destination_id, date, 'bookings' AS metric, CAST(SUM(bookings) AS DOUBLE) AS value, 'sum' AS how FROM daily_metrics GROUP BY 1, 2
  UNION ALL SELECT destination_id, date, 'search_demand', CAST(SUM(search_demand) AS DOUBLE), 'sum' FROM daily_metrics GROUP BY 1, 2
  UNION ALL SELECT destination_id, date, 'adr', AVG(adr), 'mean' FROM daily_metrics GROUP BY 1, 2
  UNION ALL SELECT destination_id, date, 'cancellations', CAST(SUM(cancellations) AS DOUBLE), 'sum' FROM daily_metrics GROUP BY 1, 2),
bnd AS (SELECT destination_id, metric, MIN(date) AS lo, MAX(date) AS hi, MIN(how) AS how FROM ds GROUP BY 1, 2),
cal AS (SELECT destination_id, metric, how, lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM bnd),
jn AS (SELECT cal.*, ds.value FROM cal LEFT JOIN ds USING (destination_id, metric, date)),
dense AS (SELECT destination_id, metric, date, CAST(date_diff('day', lo, date) AS INTEGER) AS t,
  CASE WHEN how = 'mean' THEN COALESCE(value, LAST_VALUE(value IGNORE NULLS) OVER w1, FIRST_VALUE(value IGNORE NULLS) OVER w2, 0.0)
       ELSE COALESCE(value, 0.0) END AS value
  FROM jn WINDOW w1 AS (PARTITION BY destination_id, metric ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 w2 AS (PARTITION BY destination_id, metric ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
split AS (SELECT *, COUNT(*) OVER (PARTITION BY destination_id, metric) > 30
  AND date_diff('day', date, MAX(date) OVER (PARTITION BY destination_id, metric)) < 30 AS is_test FROM dense)"""


def dense(spark, sf_dir):
    return SE.densify(SE.daily_series(fx.daily_metrics(spark, sf_dir)))


@register("w4_densify_fill", with_fixtures(DENSE_SQL, f"SELECT {cols('destination_id', 'metric', 'date', 'value:d', 't')} FROM dense"))
def w4_densify_fill(spark, sf_dir):
    """Destination x metric daily series on a gap-free calendar (sum -> 0, mean -> ffill/bfill/0)."""
    return dense(spark, sf_dir)


LAG_COLS = ", ".join(f"LAG(value, {k}) OVER (PARTITION BY destination_id, metric ORDER BY date) AS lag_{k}" for k in SE.LAG_FEATURES)
LAG_NOT_NULL = " AND ".join(f"lag_{k} IS NOT NULL" for k in SE.LAG_FEATURES)


@register("w5_lag_features", with_fixtures(DENSE_SQL + f""",
lg AS (SELECT destination_id, metric, date, value, t, {LAG_COLS} FROM dense)""", f"""
SELECT {cols('destination_id', 'metric', 'date', 'value:d', 't', *[f'lag_{k}:d' for k in SE.LAG_FEATURES])}
FROM lg WHERE {LAG_NOT_NULL}"""))
def w5_lag_features(spark, sf_dir):
    """Lag features 1, 2, 3, 7, 14, 21 per series, incomplete rows dropped."""
    return SE.lag_features(dense(spark, sf_dir))


@register("w6_decompose", with_fixtures(DENSE_SQL + """,
tr AS (SELECT *, CASE WHEN COUNT(value) OVER w = 7 THEN AVG(value) OVER w END AS trend, t % 7 AS phase FROM dense
  WINDOW w AS (PARTITION BY destination_id, metric ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
pm AS (SELECT destination_id, metric, phase, AVG(value - trend) AS pm FROM tr GROUP BY 1, 2, 3),
pm2 AS (SELECT destination_id, metric, phase, pm - AVG(pm) OVER (PARTITION BY destination_id, metric) AS seasonal FROM pm)""", f"""
SELECT {cols('tr.destination_id AS destination_id', 'tr.metric AS metric', 'date', 'value:d', 'trend:d', 'seasonal:d')},
  round(value - trend - seasonal, 6) AS residual
FROM tr LEFT JOIN pm2 ON tr.destination_id = pm2.destination_id AND tr.metric = pm2.metric AND tr.phase = pm2.phase"""))
def w6_decompose(spark, sf_dir):
    """Additive weekly decomposition (centred 7-day trend, phase means, residual)."""
    return SE.decompose(dense(spark, sf_dir))


@register("w8_train_test_split", with_fixtures(DENSE_SQL, """
SELECT destination_id, metric, COUNT(*) FILTER (WHERE NOT is_test) AS n_train, COUNT(*) FILTER (WHERE is_test) AS n_test,
  MAX(date) FILTER (WHERE NOT is_test) AS train_end FROM split GROUP BY 1, 2"""))
def w8_train_test_split(spark, sf_dir):
    """Last 30 days of every series held out."""
    s = SE.split_train_test(dense(spark, sf_dir))
    return s.groupBy("destination_id", "metric").agg(
        F.count_if(~F.col("is_test")).alias("n_train"), F.count_if(F.col("is_test")).alias("n_test"),
        F.max(F.when(~F.col("is_test"), F.col("date"))).alias("train_end"))


@register("w9_every_30th_day", with_fixtures("""
tl AS (SELECT date, CAST(SUM(bookings) AS BIGINT) AS bookings, SUM(search_demand) AS search_demand FROM daily_metrics GROUP BY date),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY date) - 1 AS pos FROM tl)""", """
SELECT date, bookings, round(search_demand, 6) AS search_demand FROM r WHERE pos % 30 = 0"""))
def w9_every_30th_day(spark, sf_dir):
    """Every 30th day of the timeline (distributed position, no single-task window)."""
    tl = fx.daily_metrics(spark, sf_dir).groupBy("date").agg(F.sum("bookings").alias("bookings"),
                                                              F.sum("search_demand").alias("search_demand"))
    return SE.every_nth_day(tl, 30)


@register("m5_seasonality", with_fixtures(DENSE_SQL + """,
c AS (SELECT *, value - AVG(value) OVER (PARTITION BY destination_id, metric) AS x FROM dense),
c2 AS (SELECT *, LEAD(x, 7) OVER w AS l7, LEAD(x, 14) OVER w AS l14, LEAD(x, 30) OVER w AS l30 FROM c
  WINDOW w AS (PARTITION BY destination_id, metric ORDER BY date)),
s AS (SELECT destination_id, metric, COUNT(*) AS n, SUM(x * x) AS c0, SUM(x * l7) AS c7, SUM(x * l14) AS c14, SUM(x * l30) AS c30
  FROM c2 GROUP BY 1, 2),
cand AS (SELECT destination_id, metric, n, k, ord, COALESCE(abs(ck / NULLIF(c0, 0)), 0.0) AS a FROM s,
  LATERAL (VALUES (7, 0, c7), (14, 1, c14), (30, 2, c30)) v(k, ord, ck) WHERE k < LEAST(30, floor(n / 2))),
best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY destination_id, metric ORDER BY a DESC, ord) AS rn FROM cand) WHERE rn = 1)""", """
SELECT s.destination_id, s.metric, s.n, CASE WHEN s.n >= 14 THEN COALESCE(b.k, 7) ELSE 7 END AS dominant_period,
  round(CASE WHEN s.n >= 14 AND b.k IS NOT NULL THEN b.a ELSE 0.0 END, 6) AS strength,
  (CASE WHEN s.n >= 14 THEN COALESCE(b.k, 7) ELSE 7 END) = 7 AS is_weekly,
  (CASE WHEN s.n >= 14 THEN COALESCE(b.k, 7) ELSE 7 END) >= 28 AS is_monthly
FROM s LEFT JOIN best b ON s.destination_id = b.destination_id AND s.metric = b.metric"""))
def m5_seasonality(spark, sf_dir):
    """M5: dominant period from |ACF| at 7 / 14 / 30 days per series."""
    return SE.detect_seasonality(dense(spark, sf_dir))


DD_SQL = """
g0 AS (SELECT destination_id, date, CAST(SUM(bookings) AS DOUBLE) AS bookings, CAST(SUM(search_demand) AS DOUBLE) AS search_demand,
  CAST(SUM(cancellations) AS DOUBLE) AS cancellations, CAST(SUM(total_reservations) AS DOUBLE) AS total_reservations
  FROM daily_metrics GROUP BY 1, 2),
b0 AS (SELECT destination_id, MIN(date) AS lo, MAX(date) AS hi FROM g0 GROUP BY 1),
c0 AS (SELECT destination_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM b0),
dd AS (SELECT c0.destination_id, c0.date, COALESCE(g0.bookings, 0.0) AS bookings, COALESCE(g0.search_demand, 0.0) AS search_demand,
  COALESCE(g0.cancellations, 0.0) AS cancellations, COALESCE(g0.total_reservations, 0.0) AS total_reservations
  FROM c0 LEFT JOIN g0 USING (destination_id, date))"""


@register("x1_x4_rolling_features", with_fixtures(DD_SQL, """
SELECT destination_id, date, round(bookings, 6) AS bookings, round(AVG(bookings) OVER w7, 6) AS bookings_ma7,
  round(LAG(search_demand, 14) OVER w, 6) AS search_lag14,
  round(SUM(cancellations) OVER w30 / NULLIF(SUM(total_reservations) OVER w30, 0), 6) AS cancellation_rate_30d,
  round(STDDEV_SAMP(bookings) OVER w30, 6) AS bookings_vol_30d
FROM dd WINDOW w AS (PARTITION BY destination_id ORDER BY date),
  w7 AS (PARTITION BY destination_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
  w30 AS (PARTITION BY destination_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""))
def x1_x4_rolling_features(spark, sf_dir):
    """X1-X4 (documented extras): 7-day MA, 14-day search lag, 30-day cancellation rate and volatility."""
    return SE.rolling_features(fx.daily_metrics(spark, sf_dir))


@register("x5_baseline_index", with_fixtures(DD_SQL + f""",
bi AS (SELECT destination_id, AVG(bookings) FILTER (WHERE date >= DATE '1998-05-25' AND date < DATE '{CRISIS_START}') AS bb,
  AVG(search_demand) FILTER (WHERE date >= DATE '1998-05-25' AND date < DATE '{CRISIS_START}') AS bs FROM dd GROUP BY 1)""", """
SELECT dd.destination_id, date, round(bookings / NULLIF(bb, 0) * 100, 6) AS bookings_index,
  round(search_demand / NULLIF(bs, 0) * 100, 6) AS search_index FROM dd JOIN bi USING (destination_id)"""))
def x5_baseline_index(spark, sf_dir):
    """X5 (documented extra): index vs the 7-day pre-crisis baseline."""
    return SE.baseline_index(fx.daily_metrics(spark, sf_dir), CRISIS_START, 7)


@register("x6_period_over_period", with_fixtures("""
m AS (SELECT destination_id, CAST(date_trunc('month', date) AS DATE) AS month, CAST(SUM(bookings) AS BIGINT) AS bookings
  FROM daily_metrics GROUP BY 1, 2)""", """
SELECT m.destination_id, m.month, m.bookings,
  round((m.bookings - pm.bookings) / NULLIF(pm.bookings, 0) * 100, 6) AS mom_pct,
  round((m.bookings - py.bookings) / NULLIF(py.bookings, 0) * 100, 6) AS yoy_pct
FROM m LEFT JOIN m pm ON pm.destination_id = m.destination_id AND pm.month = CAST(m.month - INTERVAL 1 MONTH AS DATE)
LEFT JOIN m py ON py.destination_id = m.destination_id AND py.month = CAST(m.month - INTERVAL 12 MONTH AS DATE)"""))
def x6_period_over_period(spark, sf_dir):
    """X6 (documented extra): monthly bookings with MoM and YoY %."""
    return SE.period_over_period(fx.daily_metrics(spark, sf_dir))


def _pairs_sql(days: int) -> str:
    """Daily bookings of the days before and after the crisis, by offset -> CTE pr."""
    return DD_SQL + f""",
o AS (SELECT *, date_diff('day', DATE '{CRISIS_START}', date) AS off FROM dd),
pr AS (SELECT a.destination_id, b.bookings - a.bookings AS d FROM o a JOIN o b
  ON a.destination_id = b.destination_id AND a.off + {days} = b.off WHERE a.off >= -{days} AND a.off < 0)"""


def _recursive(sql: str) -> str:
    return "WITH RECURSIVE" + sql.strip()[len("WITH"):]


# Student's t with a whole number v of degrees of freedom has a finite sum over powers of the
# cosine of atan(t / sqrt(v)), with different coefficients for odd and even v.
T_SQL = _pairs_sql(30) + """,
st AS (SELECT destination_id, COUNT(*) AS n, AVG(d) AS mean_diff, STDDEV_SAMP(d) AS sd_diff,
  AVG(d) / NULLIF(STDDEV_SAMP(d) / sqrt(COUNT(*)), 0) AS t_stat, COUNT(*) - 1 AS v, atan(abs(t_stat) / sqrt(v)) AS theta FROM pr GROUP BY 1),
terms AS (SELECT destination_id, v, theta, 0 AS k, if(v % 2 = 1, cos(theta), 1.0) AS term, if(v = 1, 0.0, if(v % 2 = 1, cos(theta), 1.0)) AS total
    FROM st WHERE t_stat IS NOT NULL AND v >= 1
  UNION ALL SELECT destination_id, v, theta, k + 1,
    term * cos(theta) * cos(theta) * if(v % 2 = 1, (2.0 * k + 2) / (2 * k + 3), (2.0 * k + 1) / (2 * k + 2)),
    total + term * cos(theta) * cos(theta) * if(v % 2 = 1, (2.0 * k + 2) / (2 * k + 3), (2.0 * k + 1) / (2 * k + 2))
  FROM terms WHERE k + 1 <= if(v % 2 = 1, (v - 3) // 2, (v - 2) // 2)),
p AS (SELECT destination_id, 1 - if(v % 2 = 1, 2 / pi() * (theta + sin(theta) * total), sin(theta) * total) AS p_value FROM terms
  QUALIFY row_number() OVER (PARTITION BY destination_id ORDER BY k DESC) = 1)"""


@register("x10_paired_t", _recursive(with_fixtures(T_SQL, """
SELECT destination_id, n, round(mean_diff, 6) AS mean_diff, round(sd_diff, 6) AS sd_diff, round(t_stat, 6) AS t_stat,
  round(if(n < 2, NULL, if(sd_diff = 0, if(mean_diff = 0, 1.0, 0.0), p_value)), 6) AS p_value FROM st LEFT JOIN p USING (destination_id)""")))
def x10_paired_t(spark, sf_dir):
    """X10 (documented extra): paired t statistic and two-sided p-value of 30 post vs 30 pre days."""
    return SE.paired_t(fx.daily_metrics(spark, sf_dir), CRISIS_START, 30)


def _signed_rank_sql(days: int) -> str:
    """Mean ranks by a window over the pairs; up to 20 of them the numbers of sign patterns by
    twice their sum, rank by rank, above the series of erf."""
    return _pairs_sql(days) + """,
rk AS (SELECT destination_id, d, rank() OVER w + (COUNT(*) OVER (PARTITION BY destination_id, abs(d)) - 1) / 2 AS r,
    row_number() OVER w AS i, COUNT(*) OVER (PARTITION BY destination_id) AS n FROM pr WHERE d <> 0 WINDOW w AS (PARTITION BY destination_id ORDER BY abs(d))),
sm AS (SELECT k.destination_id, COUNT(r) AS n, COALESCE(SUM(r) FILTER (WHERE d > 0), 0.0) AS w_plus, COALESCE(SUM(r) FILTER (WHERE d < 0), 0.0) AS w_minus
  FROM (SELECT DISTINCT destination_id FROM pr) k LEFT JOIN rk USING (destination_id) GROUP BY 1),
ti AS (SELECT destination_id, SUM(t * t * t - t) AS tied FROM (SELECT destination_id, COUNT(*)::double AS t FROM rk GROUP BY destination_id, abs(d)) GROUP BY 1),
zs AS (SELECT *, (w_plus - n * (n + 1) / 4) / NULLIF(sqrt(n * (n + 1) * (2 * n + 1) / 24 - COALESCE(tied, 0) / 48), 0) AS z FROM sm LEFT JOIN ti USING (destination_id)),
ways AS (SELECT destination_id, 0 AS i, n, list_transform(range(0, (n * (n + 1) + 1)::bigint), lambda s: if(s = 0, 1::double, 0::double)) AS c FROM sm WHERE n BETWEEN 1 AND 20
  UNION ALL SELECT w.destination_id, w.i + 1, w.n, list_transform(w.c, lambda v, s: v + if(s > 2 * r, w.c[(s - 2 * r)::bigint], 0))
  FROM ways w JOIN rk ON rk.destination_id = w.destination_id AND rk.i = w.i + 1),
ex AS (SELECT destination_id, least(1, 2 * list_sum(c[:(2 * least(w_plus, w_minus) + 1)::bigint]) / pow(2, n)) AS p
  FROM ways JOIN sm USING (destination_id, n) WHERE i = n),
se AS (SELECT destination_id, 0 AS k, least(abs(z) / sqrt(2), 6.5) AS x, x AS term, x AS total FROM zs WHERE n > 20
  UNION ALL SELECT destination_id, k + 1, x, -term * x * x * (2 * k + 1) / ((k + 1) * (2 * k + 3)), total - term * x * x * (2 * k + 1) / ((k + 1) * (2 * k + 3))
  FROM se WHERE k < 150),
no AS (SELECT destination_id, greatest(1 - 2 / sqrt(pi()) * total, 0) AS p FROM se WHERE k = 150)"""


_SIGNED_COLS = """
SELECT destination_id, zs.n, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, round(z, 6) AS z,
  round(if(zs.n = 0, 1.0, COALESCE(ex.p, no.p)), 6) AS p_value FROM zs LEFT JOIN ex USING (destination_id) LEFT JOIN no USING (destination_id)"""


@register("x10_signed_rank", _recursive(with_fixtures(_signed_rank_sql(30), _SIGNED_COLS)))
def x10_signed_rank(spark, sf_dir):
    """X10's second half (documented extra): Wilcoxon's signed-rank test of 30 post vs 30 pre days."""
    return SE.signed_rank(SE.window_pairs(fx.daily_metrics(spark, sf_dir), CRISIS_START, 30))


@register("x10_signed_rank_two_weeks", _recursive(with_fixtures(_signed_rank_sql(14), _SIGNED_COLS)))
def x10_signed_rank_two_weeks(spark, sf_dir):
    """X10's second half with 14 days a side: the exact distribution for every destination."""
    return SE.signed_rank(SE.window_pairs(fx.daily_metrics(spark, sf_dir), CRISIS_START, 14))


@register("x12_normalized_grid", with_fixtures("""
m AS (SELECT destination_id, CAST(date_trunc('month', date) AS DATE) AS period, CAST(SUM(bookings) AS BIGINT) AS bookings
  FROM daily_metrics GROUP BY 1, 2)""", """
SELECT destination_id, period, bookings,
  round(bookings / NULLIF(AVG(bookings) OVER (PARTITION BY destination_id), 0) * 100, 6) AS index FROM m"""))
def x12_normalized_grid(spark, sf_dir):
    """X12 (documented extra): destination x month normalized index grid."""
    return SE.normalized_grid(fx.daily_metrics(spark, sf_dir), "month")


@register("x13_lag_correlations", with_fixtures("""
d AS (SELECT destination_id, date, SUM(search_demand) AS x, CAST(SUM(bookings) AS DOUBLE) AS b FROM daily_metrics GROUP BY 1, 2),
l AS (SELECT x, b AS y0, LEAD(b, 7) OVER w AS y7, LEAD(b, 14) OVER w AS y14 FROM d WINDOW w AS (PARTITION BY destination_id ORDER BY date)),
u AS (SELECT 0 AS lag, x, y0 AS y FROM l UNION ALL SELECT 7, x, y7 FROM l UNION ALL SELECT 14, x, y14 FROM l)""", """
SELECT lag, COUNT(*) AS n, round(CORR(x, y), 6) AS pearson_r, round(REGR_SLOPE(y, x), 6) AS slope,
  round(REGR_INTERCEPT(y, x), 6) AS intercept, round(REGR_R2(y, x), 6) AS r2
FROM u WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY lag"""))
def x13_lag_correlations(spark, sf_dir):
    """X13 (documented extra): correlation and trend line for lags 0, 7, 14."""
    return SE.lag_correlations(fx.daily_metrics(spark, sf_dir))


CHG_SQL = """
ch0 AS (SELECT destination_id,
  CAST(SUM(bookings) FILTER (WHERE date < DATE '1998-06-01') AS DOUBLE) AS pb, CAST(SUM(bookings) FILTER (WHERE date >= DATE '1998-06-01') AS DOUBLE) AS qb,
  CAST(SUM(cancellations) FILTER (WHERE date < DATE '1998-06-01') AS DOUBLE) AS pc, CAST(SUM(cancellations) FILTER (WHERE date >= DATE '1998-06-01') AS DOUBLE) AS qc,
  SUM(search_demand) FILTER (WHERE date < DATE '1998-06-01') AS ps, SUM(search_demand) FILTER (WHERE date >= DATE '1998-06-01') AS qs,
  SUM(room_nights) FILTER (WHERE date < DATE '1998-06-01') AS pr, SUM(room_nights) FILTER (WHERE date >= DATE '1998-06-01') AS qr,
  AVG(adr) FILTER (WHERE date < DATE '1998-06-01') AS pa, AVG(adr) FILTER (WHERE date >= DATE '1998-06-01') AS qa,
  AVG(adr * COALESCE(occupancy_rate, 0.75)) FILTER (WHERE date < DATE '1998-06-01') AS pv,
  AVG(adr * COALESCE(occupancy_rate, 0.75)) FILTER (WHERE date >= DATE '1998-06-01') AS qv
  FROM daily_metrics WHERE date BETWEEN DATE '1998-05-02' AND DATE '1998-06-30' GROUP BY 1),
ch AS (SELECT destination_id, (qb - pb) / NULLIF(pb, 0) * 100 AS bookings_change_pct, (qc - pc) / NULLIF(pc, 0) * 100 AS cancellations_change_pct,
  (qs - ps) / NULLIF(ps, 0) * 100 AS search_demand_change_pct, (qr - pr) / NULLIF(pr, 0) * 100 AS room_nights_change_pct,
  (qa - pa) / NULLIF(pa, 0) * 100 AS adr_change_pct, (qv - pv) / NULLIF(pv, 0) * 100 AS revpar_change_pct FROM ch0)"""


def _changes(spark, sf_dir):
    from shockspark.plans.q_shock import W
    return KP.baseline_changes(fx.daily_metrics(spark, sf_dir), W)


@register("x7_baseline_changes", with_fixtures(CHG_SQL, f"""
SELECT {cols('destination_id', 'bookings_change_pct:d', 'cancellations_change_pct:d', 'search_demand_change_pct:d',
             'room_nights_change_pct:d', 'adr_change_pct:d', 'revpar_change_pct:d')} FROM ch"""))
def x7_baseline_changes(spark, sf_dir):
    """X7 (documented extra): post-crisis change vs the pre-crisis window, in percent."""
    return _changes(spark, sf_dir)


def _light(c, red, green):
    return (f"CASE WHEN {c}_change_pct IS NULL THEN 'none' WHEN {c}_change_pct < {red} THEN 'red' "
            f"WHEN {c}_change_pct > {green} THEN 'green' ELSE 'amber' END AS {c}_light")


@register("x15_traffic_lights", with_fixtures(CHG_SQL, f"""
SELECT destination_id, {_light('bookings', -10, 0)}, {_light('search_demand', -10, 0)}, {_light('room_nights', -10, 0)},
  CASE WHEN cancellations_change_pct IS NULL THEN 'none' WHEN cancellations_change_pct > 20 THEN 'red' ELSE 'green' END AS cancellations_light,
  CASE WHEN adr_change_pct IS NULL THEN 'none' WHEN adr_change_pct < -5 THEN 'red' ELSE 'green' END AS adr_light,
  CASE WHEN revpar_change_pct IS NULL THEN 'none' WHEN revpar_change_pct < -10 THEN 'red' ELSE 'green' END AS revpar_light
FROM ch"""))
def x15_traffic_lights(spark, sf_dir):
    """X15 (documented extra): traffic-light classes of the changes."""
    return KP.traffic_lights(_changes(spark, sf_dir))


@register("w6_decompose_extrapolated", with_fixtures(DENSE_SQL + """,
tr0 AS (SELECT *, CASE WHEN COUNT(value) OVER w = 7 THEN AVG(value) OVER w END AS trend0, t % 7 AS phase FROM dense
  WINDOW w AS (PARTITION BY destination_id, metric ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
rng AS (SELECT destination_id, metric, MIN(t) FILTER (WHERE trend0 IS NOT NULL) AS f,
  MAX(t) FILTER (WHERE trend0 IS NOT NULL) AS b FROM tr0 GROUP BY 1, 2),
fit AS (SELECT tr0.destination_id, tr0.metric,
  regr_slope(trend0, t) FILTER (WHERE t BETWEEN f AND LEAST(f + 6, b)) AS k1,
  regr_intercept(trend0, t) FILTER (WHERE t BETWEEN f AND LEAST(f + 6, b)) AS n1,
  regr_slope(trend0, t) FILTER (WHERE t BETWEEN GREATEST(b - 6, f) AND b) AS k2,
  regr_intercept(trend0, t) FILTER (WHERE t BETWEEN GREATEST(b - 6, f) AND b) AS n2
  FROM tr0 JOIN rng ON tr0.destination_id = rng.destination_id AND tr0.metric = rng.metric GROUP BY 1, 2),
tr AS (SELECT tr0.*, CASE WHEN t < rng.f THEN n1 + k1 * t WHEN t > rng.b THEN n2 + k2 * t ELSE trend0 END AS trend
  FROM tr0 JOIN rng ON tr0.destination_id = rng.destination_id AND tr0.metric = rng.metric
  JOIN fit ON tr0.destination_id = fit.destination_id AND tr0.metric = fit.metric),
pm AS (SELECT destination_id, metric, phase, AVG(value - trend) AS pm FROM tr GROUP BY 1, 2, 3),
pm2 AS (SELECT destination_id, metric, phase, pm - AVG(pm) OVER (PARTITION BY destination_id, metric) AS seasonal FROM pm)""", f"""
SELECT {cols('tr.destination_id AS destination_id', 'tr.metric AS metric', 'date', 'value:d', 'trend:d', 'seasonal:d')},
  round(value - trend - seasonal, 6) AS residual
FROM tr LEFT JOIN pm2 ON tr.destination_id = pm2.destination_id AND tr.metric = pm2.metric AND tr.phase = pm2.phase"""))
def w6_decompose_extrapolated(spark, sf_dir):
    """W6 option: decomposition with the trend extrapolated linearly at both ends."""
    return SE.decompose(dense(spark, sf_dir), extrapolate=True)


INDEX_COLUMNS = ("bookings", "cancellations", "search_demand", "adr", "room_nights")


@register("x5_index_to_30_day_mean", with_fixtures("""
g AS (SELECT destination_id, date, SUM(bookings) AS bookings, SUM(cancellations) AS cancellations, SUM(search_demand) AS search_demand,
  AVG(adr) AS adr, SUM(room_nights) AS room_nights FROM daily_metrics GROUP BY 1, 2),
b AS (SELECT destination_id, """ + ", ".join(f"AVG({c}) AS {c}" for c in INDEX_COLUMNS) + """
  FROM g WHERE date BETWEEN DATE '1998-05-02' AND DATE '1998-05-31' GROUP BY 1)""", "SELECT g.destination_id, g.date, " + ", ".join(
    f"round(g.{c} / NULLIF(b.{c}, 0) * 100, 6) AS {c}_index" for c in INDEX_COLUMNS) + """
FROM g LEFT JOIN b USING (destination_id)"""))
def x5_index_to_30_day_mean(spark, sf_dir):
    """X5 (documented extra): all metrics as an index of their 30-day pre-crisis mean."""
    return SE.index_to_mean(fx.daily_metrics(spark, sf_dir), CRISIS_START)


@register("x6_weekly_vs_prior_year", with_fixtures("""
wk AS (SELECT destination_id, CAST(date_trunc('week', date) AS DATE) AS week, CAST(SUM(bookings) AS BIGINT) AS bookings FROM daily_metrics GROUP BY 1, 2)""", """
SELECT a.destination_id, a.week, a.bookings, b.bookings AS prior_year, round(a.bookings / NULLIF(b.bookings, 0) * 100, 6) AS demand_index
FROM wk a LEFT JOIN wk b ON a.destination_id = b.destination_id AND date_diff('day', b.week, a.week) = 364"""))
def x6_weekly_vs_prior_year(spark, sf_dir):
    """X6 (documented extra): weekly bookings against the same week of the prior year."""
    return SE.weekly_vs_prior_year(fx.daily_metrics(spark, sf_dir))


@register("x12_normalized_grid_weekly", with_fixtures("""
m AS (SELECT destination_id, CAST(date_trunc('week', date) AS DATE) AS period, CAST(SUM(bookings) AS BIGINT) AS bookings FROM daily_metrics GROUP BY 1, 2)""", """
SELECT destination_id, period, bookings, round(bookings / NULLIF(AVG(bookings) OVER (PARTITION BY destination_id), 0) * 100, 6) AS index FROM m"""))
def x12_normalized_grid_weekly(spark, sf_dir):
    """X12 (documented extra): destination x week normalized index grid."""
    return SE.normalized_grid(fx.daily_metrics(spark, sf_dir), "week")
