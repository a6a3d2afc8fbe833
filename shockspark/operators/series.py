"""Many time series at once (SURVEY W4-W9, M5 and the documented extras X1-X6, X10,
X12, X13).

A series is a set of rows ``(key..., metric, date, value)`` of one long DataFrame; no
series is ever a Python object.  Every window is partitioned by the series key and
runs over the *daily aggregate* of that series, so its size is bounded by the calendar
(days in the data), not by how many raw rows a hot key holds.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shockspark.functions.distributions import normal_p, signed_rank_p, student_p
from shockspark.functions.exprs import safe_div
from shockspark.functions.ranking import value_positions

# The forecast metrics and how a day is aggregated.
FORECAST_METRICS = {"bookings": "sum", "search_demand": "sum", "adr": "mean", "cancellations": "sum"}
LAG_FEATURES = (1, 2, 3, 7, 14, 21)
ACF_CANDIDATES = (7, 14, 30)


def _d(x):
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x)[:10])


def daily_series(fact: DataFrame, keys=("destination_id",), metrics: dict = FORECAST_METRICS) -> DataFrame:
    """Long frame (keys, metric, date, value, how): one row per series and observed
    day; ``how`` is the day aggregation ('sum' or 'mean')."""
    keys = list(keys)
    aggs = [(F.sum(m) if how == "sum" else F.avg(m)).cast("double").alias(m) for m, how in metrics.items()]
    g = fact.groupBy(*keys, "date").agg(*aggs)
    items = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(how).alias("how"))
             for m, how in metrics.items()]
    return g.select(*keys, "date", F.explode(F.array(*items)).alias("s")).select(
        *keys, "s.metric", "date", "s.value", "s.how")


def densify(series: DataFrame, keys=("destination_id",)) -> DataFrame:
    """Every calendar day between the first and last observation of each series.
    Gaps of a 'sum' series are 0; a 'mean' series is forward-filled, then
    back-filled, then 0.  Adds ``t`` = day index from the series start."""
    sk = list(keys) + ["metric"]
    bounds = series.groupBy(*sk).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"),
                                     F.first("how").alias("how"))
    cal = bounds.select(*sk, "how", "_lo", F.explode(F.sequence("_lo", "_hi")).alias("date"))
    j = cal.join(series.select(*sk, "date", "value"), sk + ["date"], "left")
    w = Window.partitionBy(*sk).orderBy("date")
    ff = F.last("value", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Back-fill as a growing frame over descending dates: an "unbounded following"
    # frame is re-evaluated for every row (quadratic), a growing frame is linear.
    w_rev = Window.partitionBy(*sk).orderBy(F.col("date").desc())
    bf = F.last("value", ignorenulls=True).over(w_rev.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    value = F.when(F.col("how") == "mean", F.coalesce(F.col("value"), ff, bf, F.lit(0.0))) \
        .otherwise(F.coalesce(F.col("value"), F.lit(0.0)))
    return j.select(*sk, "date", value.alias("value"), F.datediff("date", "_lo").alias("t"))


def split_train_test(dense: DataFrame, keys=("destination_id",), test_days: int = 30) -> DataFrame:
    """``is_test`` marks the last ``test_days`` days of each series (none when the
    series has at most ``test_days`` points)."""
    sk = list(keys) + ["metric"]
    w = Window.partitionBy(*sk)
    n = F.count(F.lit(1)).over(w)
    last = F.max("date").over(w)
    return dense.withColumn("is_test", (n > test_days) & (F.datediff(last, F.col("date")) < test_days))


def lag_features(dense: DataFrame, keys=("destination_id",), lags=LAG_FEATURES) -> DataFrame:
    """Lag columns per series; rows with an incomplete lag set are dropped."""
    sk = list(keys) + ["metric"]
    w = Window.partitionBy(*sk).orderBy("date")
    out = dense.withColumns({f"lag_{k}": F.lag("value", k).over(w) for k in lags})
    return out.dropna(subset=[f"lag_{k}" for k in lags])


def decompose(dense: DataFrame, keys=("destination_id",), period: int = 7, extrapolate: bool = False) -> DataFrame:
    """Additive decomposition: trend = centred ``period``-row mean (NULL where the
    window is incomplete), seasonal = per-phase mean of the detrended values, centred
    to mean 0, residual = value - trend - seasonal.  Phase = day index mod period.

    ``extrapolate=True`` fills the trend at both ends with the least-squares line
    through the nearest ``period`` trend points (the ``extrapolate_trend='freq'`` rule
    of the usual decomposition), computed per series with ``regr_slope`` /
    ``regr_intercept`` on those points."""
    sk = list(keys) + ["metric"]
    half = period // 2
    w = Window.partitionBy(*sk).orderBy("date").rowsBetween(-half, half)
    full = F.count("value").over(w) == period
    d = dense.withColumn("trend", F.when(full, F.avg("value").over(w))) \
        .withColumn("phase", F.pmod(F.col("t"), F.lit(period)))
    if extrapolate:
        d = _extrapolate_trend(d, sk, period)
    pm = d.groupBy(*sk, "phase").agg(F.avg(F.col("value") - F.col("trend")).alias("_pm"))
    pm = pm.withColumn("_adj", F.avg("_pm").over(Window.partitionBy(*sk)))
    pm = pm.select(*sk, "phase", (F.col("_pm") - F.col("_adj")).alias("seasonal"))
    out = d.join(pm, sk + ["phase"], "left")
    return out.select(*sk, "date", "value", "trend", "seasonal",
                      (F.col("value") - F.col("trend") - F.col("seasonal")).alias("residual"))


def _extrapolate_trend(d: DataFrame, sk, npoints: int) -> DataFrame:
    rng = d.filter(F.col("trend").isNotNull()).groupBy(*sk).agg(F.min("t").alias("_f"), F.max("t").alias("_b"))
    x = d.join(rng, sk)
    front = (F.col("t") >= F.col("_f")) & (F.col("t") <= F.least(F.col("_f") + npoints - 1, F.col("_b")))
    back = (F.col("t") <= F.col("_b")) & (F.col("t") >= F.greatest(F.col("_b") - npoints + 1, F.col("_f")))
    fit = x.groupBy(*sk).agg(
        F.regr_slope(F.when(front, F.col("trend")), F.when(front, F.col("t"))).alias("_k1"),
        F.regr_intercept(F.when(front, F.col("trend")), F.when(front, F.col("t"))).alias("_n1"),
        F.regr_slope(F.when(back, F.col("trend")), F.when(back, F.col("t"))).alias("_k2"),
        F.regr_intercept(F.when(back, F.col("trend")), F.when(back, F.col("t"))).alias("_n2"))
    y = x.join(fit, sk)
    t = F.col("t")
    trend = (F.when(t < F.col("_f"), F.col("_n1") + F.col("_k1") * t)
             .when(t > F.col("_b"), F.col("_n2") + F.col("_k2") * t).otherwise(F.col("trend")))
    return y.withColumn("trend", trend).drop("_f", "_b", "_k1", "_n1", "_k2", "_n2")


def detect_seasonality(dense: DataFrame, keys=("destination_id",), max_period: int = 30,
                       include_max_lag: bool = False) -> DataFrame:
    """M5: |ACF| at 7, 14 and 30 days (full-series mean and variance, as the biased
    ACF estimator); the largest candidate wins.  Candidates must be below
    ``nlags = min(max_period, n // 2)`` as in the reference, so 30 can never win
    unless ``include_max_lag``.  Fewer than 14 points -> period 7, strength 0."""
    sk = list(keys) + ["metric"]
    w_all = Window.partitionBy(*sk)
    w = Window.partitionBy(*sk).orderBy("date")
    d = dense.withColumn("_m", F.avg("value").over(w_all)).withColumn("_x", F.col("value") - F.col("_m"))
    d = d.withColumns({f"_l{k}": F.lead("_x", k).over(w) for k in ACF_CANDIDATES})
    s = d.groupBy(*sk).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("c0"),
                           *[F.sum(F.col("_x") * F.col(f"_l{k}")).alias(f"c{k}") for k in ACF_CANDIDATES])
    nlags = F.least(F.lit(max_period), F.floor(F.col("n") / 2))
    cands = []
    for i, k in enumerate(ACF_CANDIDATES):
        ok = (F.lit(k) <= nlags) if include_max_lag else (F.lit(k) < nlags)
        acf = F.abs(safe_div(f"c{k}", "c0"))
        # Sort key: larger |acf| first, earlier candidate first on ties.
        cands.append(F.when(ok, F.struct(F.coalesce(acf, F.lit(0.0)).alias("a"), F.lit(-i).alias("o"),
                                         F.lit(k).alias("p"))))
    best = F.array_max(F.array_compact(F.array(*cands)))
    enough = F.col("n") >= 14
    return s.select(*sk, "n",
                    F.when(enough, F.coalesce(best["p"], F.lit(7))).otherwise(F.lit(7)).alias("dominant_period"),
                    F.when(enough & best.isNotNull(), best["a"]).otherwise(F.lit(0.0)).alias("strength")) \
        .withColumns({"is_weekly": F.col("dominant_period") == 7, "is_monthly": F.col("dominant_period") >= 28})


def every_nth_day(timeline: DataFrame, n: int = 30) -> DataFrame:
    """Every ``n``-th point of a day-level frame (positions 0, n, 2n, ...).  The
    position is a distributed rank on ``date`` (no single-task window)."""
    pos = value_positions(timeline.select("date"), "date").select("date", F.col("_before").alias("_pos"))
    return timeline.join(pos, "date").filter(F.col("_pos") % n == 0).drop("_pos")


# ---------------------------------------------------------------------------
# Documented extras (X1-X6, X10, X12, X13): rolling and calendar features.
# ---------------------------------------------------------------------------

def dense_daily(fact: DataFrame, keys=("destination_id",)) -> DataFrame:
    """Per (keys, date) sums of bookings, searches, cancellations, reservations on a
    gap-free calendar (gaps = 0)."""
    keys = list(keys)
    g = fact.groupBy(*keys, "date").agg(
        F.sum("bookings").cast("double").alias("bookings"),
        F.sum("search_demand").cast("double").alias("search_demand"),
        F.sum("cancellations").cast("double").alias("cancellations"),
        F.sum("total_reservations").cast("double").alias("total_reservations"))
    b = g.groupBy(*keys).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    cal = b.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias("date"))
    j = cal.join(g, keys + ["date"], "left")
    return j.select(*keys, "date", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in
                                     ("bookings", "search_demand", "cancellations", "total_reservations")])


def rolling_features(fact: DataFrame, keys=("destination_id",)) -> DataFrame:
    """7-day moving average of bookings, searches 14 days earlier, 30-day
    rolling cancellation rate (ratio of rolling sums), 30-day volatility (sample std)
    of bookings, on the gap-free daily series."""
    d = dense_daily(fact, keys)
    w = Window.partitionBy(*keys).orderBy("date")
    w7, w30 = w.rowsBetween(-6, 0), w.rowsBetween(-29, 0)
    return d.select(*keys, "date", "bookings",
                    F.avg("bookings").over(w7).alias("bookings_ma7"),
                    F.lag("search_demand", 14).over(w).alias("search_lag14"),
                    safe_div(F.sum("cancellations").over(w30), F.sum("total_reservations").over(w30))
                    .alias("cancellation_rate_30d"),
                    F.stddev_samp("bookings").over(w30).alias("bookings_vol_30d"))


def baseline_index(fact: DataFrame, crisis_start, baseline_days: int = 7, keys=("destination_id",)) -> DataFrame:
    """Daily bookings / searches indexed to the mean of the ``baseline_days``
    days before the crisis (100 = baseline)."""
    s = _d(crisis_start)
    d = dense_daily(fact, keys)
    pre = (F.col("date") >= F.lit(s - dt.timedelta(days=baseline_days))) & (F.col("date") < F.lit(s))
    base = d.groupBy(*keys).agg(F.avg(F.when(pre, F.col("bookings"))).alias("_bb"),
                                F.avg(F.when(pre, F.col("search_demand"))).alias("_bs"))
    j = d.join(base, list(keys))
    return j.select(*keys, "date", (safe_div("bookings", "_bb") * 100).alias("bookings_index"),
                    (safe_div("search_demand", "_bs") * 100).alias("search_index"))


def index_to_mean(fact: DataFrame, crisis_start, days: int = 30, keys=("destination_id",)) -> DataFrame:
    """X5, all metrics on one scale: per (keys, date) bookings, cancellations, searches,
    mean ADR and room nights, each as an index of its mean over the ``days`` days before
    the crisis (100 = mean; NULL without days or with a mean of 0)."""
    s = _d(crisis_start)
    how = {"bookings": F.sum, "cancellations": F.sum, "search_demand": F.sum, "adr": F.avg, "room_nights": F.sum}
    d = fact.groupBy(*keys, "date").agg(*[f(c).cast("double").alias(c) for c, f in how.items()])
    before = (F.col("date") >= F.lit(s - dt.timedelta(days=days))) & (F.col("date") < F.lit(s))
    w = Window.partitionBy(*keys)
    return d.select(*keys, "date", *[(safe_div(c, F.avg(F.when(before, F.col(c))).over(w)) * 100).alias(f"{c}_index") for c in how])


def weekly_vs_prior_year(fact: DataFrame, keys=("destination_id",)) -> DataFrame:
    """X6, weekly: bookings per week (from Monday), those of the same week a year (52 weeks)
    before, and the weekly index (100 = as many)."""
    keys = list(keys)
    week = fact.groupBy(*keys, F.date_trunc("week", "date").cast("date").alias("week")).agg(F.sum("bookings").alias("bookings"))
    prior = week.select(*keys, F.date_add("week", 364).alias("week"), F.col("bookings").alias("prior_year"))
    return week.join(prior, keys + ["week"], "left").withColumn("demand_index", safe_div("bookings", "prior_year") * 100)


def period_over_period(fact: DataFrame, keys=("destination_id",)) -> DataFrame:
    """Monthly bookings with month-over-month and year-over-year change in
    percent; the previous month / year come from equi-joins on the shifted month."""
    keys = list(keys)
    m = fact.groupBy(*keys, F.trunc("date", "month").alias("month")).agg(F.sum("bookings").alias("bookings"))
    prev_m = m.select(*keys, F.add_months("month", 1).alias("month"), F.col("bookings").alias("_pm"))
    prev_y = m.select(*keys, F.add_months("month", 12).alias("month"), F.col("bookings").alias("_py"))
    j = m.join(prev_m, keys + ["month"], "left").join(prev_y, keys + ["month"], "left")
    return j.select(*keys, "month", "bookings",
                    (safe_div(F.col("bookings") - F.col("_pm"), "_pm") * 100).alias("mom_pct"),
                    (safe_div(F.col("bookings") - F.col("_py"), "_py") * 100).alias("yoy_pct"))


def window_pairs(fact: DataFrame, crisis_start, days: int = 30, keys=("destination_id",)) -> DataFrame:
    """(keys, i, pre, post): daily bookings of the i-th day before and after the crisis start
    (same offset from the window starts)."""
    s = _d(crisis_start)
    d = dense_daily(fact, keys)
    off = F.datediff("date", F.lit(s))
    pre = d.filter((off >= -days) & (off < 0)).select(*keys, (off + days).alias("i"), F.col("bookings").alias("pre"))
    post = d.filter((off >= 0) & (off < days)).select(*keys, off.alias("i"), F.col("bookings").alias("post"))
    return pre.join(post, list(keys) + ["i"])


def paired_t(fact: DataFrame, crisis_start, days: int = 30, keys=("destination_id",)) -> DataFrame:
    """Paired t statistic of daily bookings, post day i vs pre day i, with its two-sided
    p-value.  No p-value with fewer than two pairs; without spread it is 0 (1 if the mean
    difference is 0, too)."""
    pairs = window_pairs(fact, crisis_start, days, keys)
    g = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("post") - F.col("pre")).alias("mean_diff"),
                                 F.stddev_samp(F.col("post") - F.col("pre")).alias("sd_diff"))
    g = g.withColumn("t_stat", safe_div("mean_diff", F.col("sd_diff") / F.sqrt("n")))
    flat = F.when(F.col("mean_diff") == 0, 1.0).otherwise(0.0)
    return g.withColumn("p_value", F.when(F.col("n") >= 2, F.when(F.col("sd_diff") == 0, flat).otherwise(student_p(F.col("t_stat"), F.col("n") - 1))))


def signed_rank(pairs: DataFrame, keys=("destination_id",), before: str = "pre", after: str = "post", exact: int = 20) -> DataFrame:
    """Wilcoxon's signed-rank test of ``after`` - ``before`` for each key: n (pairs that differ),
    w_plus and w_minus (sums of mean ranks), z and the two-sided p_value.  Up to ``exact``
    differing pairs the p-value is that of all sign patterns of the ranks, ties included; above it
    is the normal tail with the variance corrected for ties (no continuity correction).
    Pairs with a missing or non-finite side are left out; without a differing pair the p-value
    is 1.  Equal differences are counted first, so a key's ranks are a window over its
    different values, not over its pairs."""
    sk = list(keys)
    diff = (F.col(after) - F.col(before)).cast("double")
    known = pairs.select(*sk, diff.alias("d")).filter(F.col("d").isNotNull() & ~F.isnan("d") & (F.abs("d") < float("inf")))
    ties = known.groupBy(*sk, F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("up"))
    some = F.col("size") > 0
    by_size = Window.partitionBy(*sk).orderBy("size")
    count = F.when(some, F.col("t")).otherwise(0)
    ranked = ties.withColumns({"c": count, "below": F.coalesce(F.sum(count).over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                               "n": F.sum(count).over(Window.partitionBy(*sk))})
    twice = F.when(some, 2 * F.col("below") + F.col("t") + 1)
    small = F.when(some & (F.col("n") <= exact), F.array_repeat(twice.cast("int"), F.col("t").cast("int")))
    sums = ranked.groupBy(*sk).agg(F.max("n").alias("n"), F.coalesce(F.sum(twice * F.col("up")), F.lit(0)).alias("up2"),
                                   F.coalesce(F.sum(F.when(some, F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double")), F.lit(0.0)).alias("tied"),
                                   F.flatten(F.collect_list(small)).alias("ranks"))
    n = F.col("n").cast("double")
    plus, whole = F.col("up2") / 2, n * (n + 1) / 2
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48)
    z = safe_div(plus - whole / 2, spread)
    p = F.when(F.col("n") == 0, 1.0).when(F.col("n") <= exact, signed_rank_p(F.col("ranks"), F.col("up2").cast("int"))).otherwise(normal_p(z))
    return sums.select(*sk, "n", plus.alias("w_plus"), (whole - plus).alias("w_minus"), z.alias("z"), p.alias("p_value"))


def normalized_grid(fact: DataFrame, grain: str = "month", keys=("destination_id",)) -> DataFrame:
    """Destination x week / month bookings indexed to the destination's mean
    period (100 = mean), long form."""
    per = F.trunc("date", grain) if grain in ("month", "year") else F.date_trunc("week", "date").cast("date")
    m = fact.groupBy(*keys, per.alias("period")).agg(F.sum("bookings").alias("bookings"))
    w = Window.partitionBy(*keys)
    return m.withColumn("index", safe_div("bookings", F.avg("bookings").over(w)) * 100)


def lag_correlations(fact: DataFrame, lags=(0, 7, 14)) -> DataFrame:
    """searches(t) vs bookings(t + lag) per lag on the (destination, date)
    aggregate: correlation and the regression line."""
    d = fact.groupBy("destination_id", "date").agg(F.sum("search_demand").alias("x"), F.sum("bookings").alias("b"))
    w = Window.partitionBy("destination_id").orderBy("date")
    d = d.withColumns({f"_y{k}": (F.col("b") if k == 0 else F.lead("b", k).over(w)).cast("double") for k in lags})
    long = d.select("x", F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_y{k}").alias("y"))
                                             for k in lags])).alias("s")).select("s.lag", "x", "s.y")
    long = long.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    return long.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("pearson_r"),
                                   F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
                                   F.regr_r2("y", "x").alias("r2"))
