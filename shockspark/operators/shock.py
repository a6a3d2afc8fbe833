"""Demand-shock analytics: pre/post aggregates, shock metrics, resilience, rankings,
substitution flows and search/booking correlation (SURVEY A2-A14, A27-A28, A49-A50,
J1, J4, J6, W1-W3, T1, T3-T5).

Units follow the reference: shock ``*_change_pct`` columns are **fractions**
(-0.25 = 25 % drop); the elasticity and corridor measures are in percent.

Plan shape: one scan of the fact with a literal date filter (pushed to Parquet), one
hash aggregate with partial aggregation (shuffle bounded by destinations), then
column expressions.  The reference scans the fact twice (pre, post) and joins; the
one-pass conditional aggregate gives the same rows (``pre_post_full_outer`` keeps the
two-scan form as a named variant and the tests check both agree).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shockspark.functions.exprs import (clip, div_if_positive, pct_change, safe_div,
                                        stability_normalize)
from shockspark.functions.ranking import spearman, with_rank
from shockspark.operators.windows import CrisisWindow, window_days

# Weights of the resilience index (Python form and SQL form).
RESILIENCE_WEIGHTS = {
    "booking_recovery": 0.30,
    "search_demand": 0.20,
    "adr_stability": 0.15,
    "cancellation": 0.15,
    "demand_volatility": 0.20,
}
RESILIENCE_WEIGHTS_SQL = {
    "booking_recovery": 0.35,
    "search_demand": 0.25,
    "adr_stability": 0.20,
    "cancellation": 0.20,
}
# Travel risk weights and tiers.
RISK_WEIGHTS = {"booking": 0.4, "cancel": 0.35, "adr": 0.25}
RISK_TIERS = [(0.0, 0.33, "Low Risk"), (0.33, 0.66, "Medium Risk"), (0.66, 1.0, "High Risk")]

SUM_COLS = [("bookings", "bookings"), ("cancellations", "cancellations"),
            ("total_reservations", "total"), ("search_demand", "searches")]


def _side_aggs(flag, prefix: str) -> list:
    """Aggregates of one side (pre or post).  A sum is NULL when the side has no rows
    (the reference's outer merge) and 0 when it has rows whose values are all NULL
    (pandas ``sum``)."""
    has_rows = F.count_if(flag) > 0
    out = []
    for src, name in SUM_COLS:
        out.append(F.when(has_rows, F.coalesce(F.sum(F.when(flag, F.col(src))), F.lit(0)))
                   .alias(f"{prefix}_{name}"))
    out.append(F.avg(F.when(flag, F.col("adr"))).alias(f"{prefix}_adr"))
    return out


def _tag(fact: DataFrame, window, keys) -> tuple[DataFrame, list]:
    """Restrict the fact to the analysis window and add ``_pre`` / ``_post`` flags.

    ``window`` is a ``CrisisWindow`` (literal, pushed-down filter) or a crisis table
    (all crises at once through the day-expanded equi-join of ``window_days``)."""
    keys = list(keys)
    if isinstance(window, CrisisWindow):
        tagged = fact.filter(window.in_window("date")).withColumns(
            {"_pre": F.col("date") < F.lit(window.crisis_start),
             "_post": F.col("date") >= F.lit(window.crisis_start)})
        return tagged, keys
    pre_days, post_days, crises = window
    days = window_days(crises, pre_days, post_days).withColumnRenamed("is_pre", "_pre") \
        .withColumnRenamed("is_post", "_post")
    tagged = fact.drop("crisis_id").join(days, "date")
    return tagged, ["crisis_id"] + [k for k in keys if k != "crisis_id"]


def all_crises(crises: DataFrame, pre_days: int = 30, post_days: int = 30):
    """Window spec for every crisis of ``crises``."""
    return (pre_days, post_days, crises)


def pre_post_aggregates(fact: DataFrame, window, keys=("destination_id",)) -> DataFrame:
    """SURVEY A2/A3: pre and post sums / means per key in one pass, with the
    cancellation rates (0 when the total is 0 or missing) and the post-window
    coefficient of variation inputs.  Rows without a key are left out."""
    tagged, keys = _tag(fact, window, keys)
    pre, post = F.col("_pre"), F.col("_post")
    agg = tagged.dropna(subset=keys).groupBy(*keys).agg(
        *_side_aggs(pre, "pre"), *_side_aggs(post, "post"),
        F.avg(F.when(post, F.col("bookings"))).alias("_post_mean"),
        F.stddev_samp(F.when(post, F.col("bookings"))).alias("_post_std"),
        F.count_if(post).alias("_post_rows"),
    )
    return agg.withColumns({
        "pre_cancellation_rate": div_if_positive("pre_cancellations", "pre_total", 0.0),
        "post_cancellation_rate": div_if_positive("post_cancellations", "post_total", 0.0),
    })


def pre_post_full_outer(fact: DataFrame, window: CrisisWindow, keys=("destination_id",)) -> DataFrame:
    """SURVEY J1: the reference's two scans joined FULL OUTER on the keys.  Same rows as
    ``pre_post_aggregates``; kept as the literal form of the reference plan."""
    keys = list(keys)

    def side(flag, prefix):
        part = fact.filter(flag).dropna(subset=keys)
        return part.groupBy(*keys).agg(
            *[F.coalesce(F.sum(src), F.lit(0)).alias(f"{prefix}_{name}") for src, name in SUM_COLS],
            F.avg("adr").alias(f"{prefix}_adr"))

    pre = side(window.is_pre(), "pre")
    post = side(window.is_post(), "post")
    j = pre.join(post, keys, "full")
    return j.withColumns({
        "pre_cancellation_rate": div_if_positive("pre_cancellations", "pre_total", 0.0),
        "post_cancellation_rate": div_if_positive("post_cancellations", "post_total", 0.0),
    })


SHOCK_COLUMNS = ["pre_bookings", "pre_cancellations", "pre_total", "pre_searches", "pre_adr",
                 "post_bookings", "post_cancellations", "post_total", "post_searches", "post_adr",
                 "pre_cancellation_rate", "post_cancellation_rate", "booking_change_pct",
                 "search_change_pct", "adr_change_pct", "cancellation_spike", "post_booking_cv"]


def shock_metrics(fact: DataFrame, window, keys=("destination_id",)) -> DataFrame:
    """SURVEY A4 + A5 (Python form): the four shock metrics as fractions and the post
    booking CV (mean > 0: std / mean, 0.5 with one value; otherwise 1.0, an all-null
    post window included; 0.5 without a post window)."""
    agg = pre_post_aggregates(fact, window, keys)
    m, s = F.col("_post_mean"), F.col("_post_std")
    cv = F.when(F.col("_post_rows") == 0, F.lit(0.5)).when(m > 0, F.coalesce(safe_div(s, m), F.lit(0.5))).otherwise(F.lit(1.0))
    out = agg.withColumns({
        "booking_change_pct": pct_change("post_bookings", "pre_bookings"),
        "search_change_pct": pct_change("post_searches", "pre_searches"),
        "adr_change_pct": pct_change("post_adr", "pre_adr"),
        "cancellation_spike": F.col("post_cancellation_rate") - F.col("pre_cancellation_rate"),
        "post_booking_cv": cv,
    })
    keys_out = [c for c in out.columns if c not in SHOCK_COLUMNS and not c.startswith("_")]
    return out.select(*keys_out, *SHOCK_COLUMNS)


def shock_metrics_sql(fact: DataFrame, window: CrisisWindow, keys=("destination_id", "crisis_id"),
                      view_post_days: int | None = None) -> DataFrame:
    """SURVEY A4 (SQL form) and A6 (the reusable view).  Rates are NULL when the total
    is 0; rows need ``pre_bookings > 0 or post_bookings > 0``.  ``view_post_days=31``
    reproduces the view, whose post window ends at ``start + 30`` inclusive (it does
    not apply the row filter)."""
    w = window if view_post_days is None else CrisisWindow(window.crisis_start, window.pre_days, view_post_days)
    if "crisis_id" in keys:
        fact = fact.withColumn("crisis_id", F.coalesce("crisis_id", F.lit(0)))
    agg = pre_post_aggregates(fact, w, keys)
    pre_rate = safe_div("pre_cancellations", "pre_total")
    post_rate = safe_div("post_cancellations", "post_total")
    out = agg.select(
        *list(keys), "pre_bookings", "post_bookings", "pre_searches", "post_searches", "pre_adr", "post_adr",
        pre_rate.alias("pre_cancellation_rate"), post_rate.alias("post_cancellation_rate"),
        pct_change("post_bookings", "pre_bookings").alias("booking_change_pct"),
        pct_change("post_searches", "pre_searches").alias("search_change_pct"),
        pct_change("post_adr", "pre_adr").alias("adr_change_pct"),
        (post_rate - pre_rate).alias("cancellation_spike"))
    if view_post_days is None:
        out = out.filter((F.col("pre_bookings") > 0) | (F.col("post_bookings") > 0))
    return out


def resilience_scores(shock: DataFrame) -> DataFrame:
    """SURVEY A7: destination resilience index, Python form (five components; the
    volatility score is 0.5 for a frame without ``post_booking_cv``)."""
    W = RESILIENCE_WEIGHTS
    pre_b, post_b = F.col("pre_bookings"), F.col("post_bookings")
    ratio_b = clip(F.when(pre_b > 0, safe_div(post_b, pre_b)).otherwise(F.lit(0.0)), lo=0.0)
    has_search = F.col("pre_searches").isNotNull() & (F.col("pre_searches") > 0)
    ratio_s = clip(safe_div("post_searches", "pre_searches"), lo=0.0)
    chg = F.col("adr_change_pct")
    df = shock.withColumns({
        "booking_recovery_score": stability_normalize(ratio_b),
        "search_demand_score": F.when(has_search, stability_normalize(ratio_s)).otherwise(F.lit(0.5)),
        "adr_stability_score": F.when(chg.isNotNull(), clip(F.lit(1.0) + chg, 0.0, 1.0)).otherwise(F.lit(0.5)),
        "cancellation_resilience": F.lit(1.0) - clip("cancellation_spike", 0.0, 1.0),
        "demand_volatility_score": (F.lit(1.0) - clip("post_booking_cv", 0.0, 1.0) if "post_booking_cv" in shock.columns
                                    else F.lit(0.5)),
    })
    return df.withColumn(
        "resilience_score",
        W["booking_recovery"] * F.col("booking_recovery_score")
        + W["search_demand"] * F.col("search_demand_score")
        + W["adr_stability"] * F.col("adr_stability_score")
        + W["cancellation"] * F.col("cancellation_resilience")
        + W["demand_volatility"] * F.col("demand_volatility_score"))


def add_rank_desc(df: DataFrame, value_col: str, rank_col: str, partition=()) -> DataFrame:
    """RANK (method min) by ``value_col`` descending; NULL values get a NULL rank.

    Without partition keys the rank is a distributed prefix sum over distinct values
    (``functions.ranking``), never a single-task window.  With keys (e.g. one rank per
    crisis) it is a window partitioned by those keys."""
    cols = df.columns
    if not partition:
        return with_rank(df, value_col, rank_col, descending=True).select(*cols, rank_col)
    w = Window.partitionBy(*partition).orderBy(F.col(value_col).desc_nulls_last())
    return df.withColumn(rank_col, F.when(F.col(value_col).isNotNull(), F.rank().over(w).cast("bigint")))


def rank_by_resilience(shock: DataFrame, min_pre_bookings: float = 10, partition=()) -> DataFrame:
    """SURVEY W2: resilience ranking of destinations with enough pre-crisis bookings."""
    scored = resilience_scores(shock).filter(F.col("pre_bookings") >= min_pre_bookings)
    return add_rank_desc(scored, "resilience_score", "resilience_rank", partition)


def resilience_sql_form(fact: DataFrame, window: CrisisWindow, min_pre_bookings: float = 10) -> DataFrame:
    """SURVEY A8: the SQL resilience index (four components, weights 0.35/0.25/0.20/0.20,
    every score clipped to [0, 1], no volatility term), ranked."""
    W = RESILIENCE_WEIGHTS_SQL
    agg = pre_post_aggregates(fact, window, ("destination_id",)).filter(
        F.col("pre_bookings") >= min_pre_bookings)
    spike = safe_div("post_cancellations", "post_total") - safe_div("pre_cancellations", "pre_total")

    def unit(x):
        # LEAST(1, GREATEST(0, x)) with SQL semantics: NULL arguments are skipped.
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))

    scored = agg.select(
        "destination_id",
        unit(safe_div("post_bookings", "pre_bookings")).alias("booking_recovery_score"),
        F.when(F.col("pre_searches") > 0, unit(safe_div("post_searches", "pre_searches")))
         .otherwise(F.lit(0.5)).alias("search_demand_score"),
        unit(F.lit(1.0) + pct_change("post_adr", "pre_adr")).alias("adr_stability_score"),
        unit(spike).alias("cancellation_spike_raw"))
    score = (W["booking_recovery"] * F.col("booking_recovery_score")
             + W["search_demand"] * F.col("search_demand_score")
             + W["adr_stability"] * F.col("adr_stability_score")
             + W["cancellation"] * (F.lit(1.0) - F.col("cancellation_spike_raw")))
    out = scored.withColumn("resilience_score", score).select(
        "destination_id", "resilience_score", "booking_recovery_score", "search_demand_score",
        "adr_stability_score")
    return add_rank_desc(out, "resilience_score", "resilience_rank")


def top_destinations(shock: DataFrame, n: int = 10, gaining: bool = True,
                     min_pre_bookings: float = 10) -> DataFrame:
    """SURVEY T1: top ``n`` gaining (or losing) destinations by booking change; ties
    broken by destination id.  ``orderBy().limit()`` plans as TakeOrderedAndProject:
    each task keeps its own top n, only n rows per task reach the final merge."""
    chg = F.col("booking_change_pct")
    order = [chg.desc_nulls_last() if gaining else chg.asc_nulls_last(), F.col("destination_id")]
    return (shock.filter(F.col("pre_bookings") >= min_pre_bookings)
            .orderBy(*order).limit(n)
            .select("destination_id", "booking_change_pct", "pre_bookings", "post_bookings"))


def substitution_ranking(shock: DataFrame, min_pre_bookings: float | None = None) -> DataFrame:
    """SURVEY W1: demand direction and substitution rank (RANK by change, desc).
    The Python form has no minimum (``min_pre_bookings=None``); the SQL form uses 10."""
    df = shock if min_pre_bookings is None else shock.filter(F.col("pre_bookings") >= min_pre_bookings)
    chg = F.col("booking_change_pct")
    out = df.select("destination_id", "booking_change_pct",
                    F.when(chg > 0, "gaining").otherwise("losing").alias("demand_direction"))
    return add_rank_desc(out, "booking_change_pct", "substitution_rank")


def sankey_flows(shock: DataFrame, max_losers: int = 5, max_gainers: int = 5,
                 min_flow: float = 5.0) -> DataFrame:
    """SURVEY A9 / J6: reallocated demand from the ``max_losers`` biggest losers to the
    ``max_gainers`` biggest gainers; flow = 0.7 min(total loss, total gain) x loss share
    x gain share, kept when > ``min_flow``, rounded half-even.

    Both sides are ``limit(k)`` frames.  The gainer list (at most ``max_gainers``
    entries) and the two totals are scalar subqueries evaluated once; each loser row
    expands the gainer list, so the output is at most k x k rows."""
    chg = F.col("booking_change_pct")
    losers = (shock.filter(chg < 0).orderBy(chg.asc(), "destination_id").limit(max_losers)
              .select(F.col("destination_id").alias("source"),
                      (F.col("pre_bookings") * F.abs(chg)).cast("double").alias("lost")))
    gainers = (shock.filter(chg > 0).orderBy(chg.desc(), "destination_id").limit(max_gainers)
               .select(F.col("destination_id").alias("target"),
                       (F.col("post_bookings") - F.col("pre_bookings")).cast("double").alias("gained")))
    total_loss = losers.agg(F.sum("lost")).scalar()
    total_gain = gainers.agg(F.sum("gained")).scalar()
    gain_list = gainers.agg(F.collect_list(F.struct("target", "gained"))).scalar()
    pairs = losers.select("source", "lost", F.explode(gain_list).alias("g"),
                          total_loss.alias("total_loss"), total_gain.alias("total_gain"))
    realloc = F.least("total_loss", "total_gain") * F.lit(0.7)
    flow = realloc * safe_div("lost", "total_loss") * safe_div("g.gained", "total_gain")
    valid = (F.col("total_loss") > 0) & (F.col("total_gain") > 0)
    return (pairs.filter(valid).withColumn("flow", flow).filter(F.col("flow") > min_flow)
            .select("source", F.col("g.target").alias("target"),
                    F.bround("flow", 0).cast("bigint").alias("value")))


def sankey_nodes(flows: DataFrame) -> DataFrame:
    """SURVEY A10: node totals of the flows (outgoing for sources, incoming for targets)."""
    out = flows.groupBy(F.col("source").alias("node")).agg(F.sum("value").alias("total_value")) \
        .withColumn("side", F.lit("source"))
    inc = flows.groupBy(F.col("target").alias("node")).agg(F.sum("value").alias("total_value")) \
        .withColumn("side", F.lit("target"))
    return out.unionByName(inc).select("side", "node", "total_value")


def top_flows(flows: DataFrame, n: int = 10) -> DataFrame:
    """SURVEY A10: the ``n`` largest flows."""
    return flows.orderBy(F.col("value").desc(), "source", "target").limit(n)


def _daily_by_destination(fact: DataFrame) -> DataFrame:
    """Aggregate to one row per (destination, date) before any row shift."""
    return fact.groupBy("destination_id", "date").agg(
        F.sum("search_demand").alias("search_demand"), F.sum("bookings").alias("bookings"))


def search_booking_correlation(fact: DataFrame, lag_days: int = 0, direction: str = "python",
                               daily: bool = False) -> DataFrame:
    """SURVEY A11/A12/A14: Pearson r, Spearman rho, r^2 and n of searches and bookings.

    Without a lag the pairs are the fact rows; ``daily=True`` sums them to (destination,
    date) first.  With ``lag_days`` the daily sums are shifted by that many rows per
    destination: ``direction='python'`` pairs bookings(t) with searches(t+lag), ``'sql'``
    pairs searches(t) with bookings(t+lag).  Fewer than 3 pairs -> NULL statistics and
    n = 0."""
    d = _daily_by_destination(fact) if lag_days or daily else fact
    x, y = F.col("search_demand"), F.col("bookings")
    if lag_days:
        w = Window.partitionBy("destination_id").orderBy("date")
        if direction == "python":
            x = F.lead("search_demand", lag_days).over(w)
        else:
            y = F.lead("bookings", lag_days).over(w)
    pairs = d.select(x.cast("double").alias("x"), y.cast("double").alias("y")).filter("x is not null and y is not null")
    enough = F.col("n") >= 3
    stats = pairs.agg(F.corr("x", "y").alias("pearson_r"), F.count(F.lit(1)).alias("n"))
    rho = spearman(pairs, "x", "y").scalar()
    return stats.select(
        F.when(enough, F.col("pearson_r")).alias("pearson_r"),
        F.when(enough, rho).alias("spearman_rho"),
        F.when(enough, F.col("pearson_r") * F.col("pearson_r")).alias("r_squared"),
        F.when(enough, F.col("n")).otherwise(F.lit(0)).alias("n"))


def correlation_by_destination(fact: DataFrame, min_n: int = 10) -> DataFrame:
    """SURVEY A13: per-destination CORR(searches, bookings) over rows with searches > 0,
    HAVING count >= ``min_n``."""
    return (fact.filter(F.col("search_demand").isNotNull() & (F.col("search_demand") > 0))
            .groupBy("destination_id")
            .agg(F.corr("search_demand", "bookings").alias("pearson_r"), F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_n))


def lagged_correlation_by_destination(fact: DataFrame, lag: int = 7, min_n: int = 10) -> DataFrame:
    """SURVEY A14 (SQL form) / W3: searches(t) vs bookings 7 rows later per destination,
    on the (destination, date) aggregate; HAVING count >= ``min_n``."""
    d = _daily_by_destination(fact)
    w = Window.partitionBy("destination_id").orderBy("date")
    d = d.withColumn("bookings_lag", F.lead("bookings", lag).over(w))
    return (d.filter(F.col("search_demand").isNotNull() & F.col("bookings_lag").isNotNull())
            .groupBy("destination_id")
            .agg(F.corr("search_demand", "bookings_lag").alias("search_booking_corr_lag7"),
                 F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_n))


def bookings_lead(fact: DataFrame, lag: int = 7) -> DataFrame:
    """SURVEY W3: LEAD(bookings, lag) per destination by date on the daily aggregate."""
    d = _daily_by_destination(fact)
    w = Window.partitionBy("destination_id").orderBy("date")
    return d.select("destination_id", "date", "search_demand", "bookings",
                    F.lead("bookings", lag).over(w).alias(f"bookings_lead{lag}"))


def conversion_elasticity(fact: DataFrame, window: CrisisWindow) -> DataFrame:
    """SURVEY A27: search-to-booking conversion before and after, change in percent."""
    agg = pre_post_aggregates(fact, window, ("destination_id",))
    pre_c = div_if_positive("pre_bookings", "pre_searches")
    post_c = div_if_positive("post_bookings", "post_searches")
    out = agg.select("destination_id", "pre_bookings", "pre_searches", "post_bookings", "post_searches",
                     pre_c.alias("pre_conversion"), post_c.alias("post_conversion"))
    return out.withColumn(
        "conversion_change_pct",
        F.when(F.col("pre_conversion") > 0,
               safe_div(F.col("post_conversion") - F.col("pre_conversion"), "pre_conversion") * 100))


def travel_risk_index(shock: DataFrame) -> DataFrame:
    """SURVEY A28: composite risk 0.4 booking + 0.35 cancellation + 0.25 ADR, tiers
    right-closed (0, .33], (.33, .66], (.66, 1]; exactly 0 (or NULL) -> 'unknown', and
    ``risk_level`` low / medium / high / unknown.  A missing input column counts as a
    booking risk of 0.5, a cancellation risk of 0 or an ADR risk of 0; a frame with none
    of the three comes back unchanged."""
    W = RISK_WEIGHTS
    have = set(shock.columns) & {"booking_change_pct", "cancellation_spike", "adr_change_pct"}
    if not have:
        return shock
    df = shock.withColumns({
        "risk_booking": (F.lit(1.0) - (clip(F.col("booking_change_pct") * 100, -100.0, 100.0) + 100) / 200
                         if "booking_change_pct" in have else F.lit(0.5)),
        "risk_cancel": clip("cancellation_spike", 0.0, 1.0) if "cancellation_spike" in have else F.lit(0.0),
        "risk_adr": clip(F.abs(F.col("adr_change_pct") * 100) / 50, 0.0, 1.0) if "adr_change_pct" in have else F.lit(0.0),
    })
    idx = W["booking"] * F.col("risk_booking") + W["cancel"] * F.col("risk_cancel") + W["adr"] * F.col("risk_adr")
    df = df.withColumn("travel_risk_index", idx)
    x = F.col("travel_risk_index")
    tier, level = F.lit("unknown"), F.lit("unknown")
    for lo, hi, label in reversed(RISK_TIERS):
        inside = (x > lo) & (x <= hi)
        tier = F.when(inside, F.lit(label)).otherwise(tier)
        level = F.when(inside, F.lit(label.split()[0].lower())).otherwise(level)
    return df.withColumn("risk_tier", tier).withColumn("risk_level", level)


def risk_extremes(risk: DataFrame, n: int = 10, highest: bool = True) -> DataFrame:
    """SURVEY A28: the ``n`` highest (or lowest) risk destinations."""
    x = F.col("travel_risk_index")
    return risk.filter(x.isNotNull()).orderBy(x.desc() if highest else x.asc(), "destination_id").limit(n)


def top_by_abs_change(shock: DataFrame, column: str, n: int = 10, nonzero: bool = False) -> DataFrame:
    """SURVEY T3: top ``n`` by |column| (booking / search / ADR change, or a non-zero
    cancellation spike)."""
    c = F.col(column)
    df = shock.filter(c.isNotNull())
    if nonzero:
        df = df.filter(c != 0)
    return df.orderBy(F.abs(c).desc(), "destination_id").limit(n).select(
        "destination_id", column, F.abs(c).alias("abs_value"))


def top_post_bookings(shock: DataFrame, n: int = 10) -> DataFrame:
    """SURVEY T4: top ``n`` by post-crisis bookings with their position."""
    top = shock.filter(F.col("post_bookings").isNotNull()).orderBy(
        F.col("post_bookings").desc(), "destination_id").limit(n)
    w = Window.orderBy(F.col("post_bookings").desc(), "destination_id")
    return top.select(F.row_number().over(w).cast("bigint").alias("position"), "destination_id", "post_bookings",
                      "booking_change_pct")


def threshold_lists(shock: DataFrame, threshold_pct: float = 10.0) -> DataFrame:
    """SURVEY T5: destinations whose booking change (in percent) is beyond
    +/- ``threshold_pct``.  The UI compared the fraction with 10; here the fraction is
    converted to percent first (documented unit fix)."""
    pct = F.col("booking_change_pct") * 100
    return shock.select(
        "destination_id", pct.alias("booking_change_percent"),
        F.when(pct >= threshold_pct, "gaining").when(pct <= -threshold_pct, "losing").alias("list")
    ).filter(F.col("list").isNotNull())


def crisis_impact_table(fact: DataFrame, crises: DataFrame, pre_days: int = 30, post_days: int = 30,
                        top_k: int = 3) -> DataFrame:
    """SURVEY A49: one row per crisis: total booking impact %, the ``top_k`` biggest
    losers, mean decline and its severity class (High > .30, Medium > .15, Low).
    All crises are analysed in one scan (J4)."""
    shock = shock_metrics(fact, all_crises(crises, pre_days, post_days))
    chg = F.col("booking_change_pct")
    w = Window.partitionBy("crisis_id").orderBy(chg.asc_nulls_last(), "destination_id")
    losers = shock.filter(chg < 0).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top_k)
    top = losers.groupBy("crisis_id").agg(
        F.array_sort(F.collect_list(F.struct("_r", "destination_id"))).alias("_l")).select(
        "crisis_id", F.array_join(F.transform("_l", lambda s: s["destination_id"]), ", ").alias("top_losers"))
    tot = shock.groupBy("crisis_id").agg(
        F.sum("pre_bookings").alias("pre_bookings"), F.sum("post_bookings").alias("post_bookings"),
        F.avg(F.when(chg < 0, -chg)).alias("mean_decline"))
    out = tot.join(top, "crisis_id", "left").withColumn(
        "total_impact_pct", pct_change("post_bookings", "pre_bookings") * 100)
    md = F.col("mean_decline")
    return out.select("crisis_id", "pre_bookings", "post_bookings", "total_impact_pct",
                      F.coalesce("top_losers", F.lit("")).alias("top_losers"),
                      "mean_decline",
                      F.when(md > 0.30, "High").when(md > 0.15, "Medium").otherwise("Low").alias("severity"))


def shock_overview(shock_risk: DataFrame, high_risk: float = 0.66) -> DataFrame:
    """SURVEY A50: averages of the shock columns, share of gaining destinations and the
    count of high-risk destinations (input: ``travel_risk_index`` output)."""
    chg = F.col("booking_change_pct")
    return shock_risk.agg(
        F.avg("booking_change_pct").alias("avg_booking_change_pct"),
        F.avg("search_change_pct").alias("avg_search_change_pct"),
        F.avg("adr_change_pct").alias("avg_adr_change_pct"),
        F.avg("cancellation_spike").alias("avg_cancellation_spike"),
        (F.count_if(chg > 0) * 100.0 / F.count(F.lit(1))).alias("gaining_share_pct"),
        F.count_if(F.col("travel_risk_index") > high_risk).alias("high_risk_count"),
        F.count(F.lit(1)).alias("destinations"))
