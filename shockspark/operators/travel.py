"""Travel-demand funnel: flights, visas and bookings in one filter context, with lead,
growth and shock measures (SURVEY A34-A45, J5, J8, J10, T2).

The reference re-reads and re-filters both fact tables for each of seven shifted
windows.  Here every window of a request is a literal date range and each fact is
scanned **once**: one aggregate with a conditional sum per (window, measure), and the
union of the window ranges is a pushed-down scan filter.  ``windowed_totals`` is the
general form for a table of many windows: each is the difference of two running totals
(``cumulative.py``).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shockspark.functions.exprs import round_python, safe_div
from shockspark.operators.cumulative import running_totals, window_totals

# Lead-window shifts (days) and the stay estimate per booking.
FLIGHT_LEADS = (30, 60)
VISA_LEADS = (15, 30)
WOW_DAYS = 7
YOY_DAYS = 365
STAY_NIGHTS_PER_BOOKING = 2.8
TREND_BAND = 0.02


def _d(x):
    if x is None or isinstance(x, dt.date):
        return x
    return dt.date.fromisoformat(str(x)[:10])


@dataclass(frozen=True)
class TravelContext:
    """Filter context of one travel-demand request."""

    date_from: dt.date | None = None
    date_to: dt.date | None = None
    destination: str | None = None
    source_market: str | None = None
    travel_type: str | None = None
    crisis_id: int | None = None

    @staticmethod
    def of(date_from=None, date_to=None, **kw) -> "TravelContext":
        return TravelContext(_d(date_from), _d(date_to), **kw)

    def resolved(self, crises: DataFrame) -> "TravelContext":
        """Dates that are not given are those of the crisis ``crisis_id`` (a look-up of
        one row); an unknown crisis, or an open end, leaves them open."""
        if self.crisis_id is None or (self.date_from and self.date_to):
            return self
        row = crises.filter(F.col("crisis_id") == self.crisis_id).select("crisis_start_date", "crisis_end_date").first()
        start, end = row or (None, None)
        return replace(self, date_from=self.date_from or start, date_to=self.date_to or end)

    def windows(self) -> dict[str, tuple[dt.date, dt.date]]:
        """Named windows (inclusive); empty without both dates."""
        if not (self.date_from and self.date_to):
            return {}
        a, b = self.date_from, self.date_to
        sh = lambda k: (a - dt.timedelta(days=k), b - dt.timedelta(days=k))
        span = (b - a).days + 1
        out = {"cur": (a, b)}
        for k in FLIGHT_LEADS:
            out[f"lead{k}"] = sh(k)
        for k in VISA_LEADS:
            out[f"lead{k}"] = sh(k)
        if span > 0:
            out["prev"] = (a - dt.timedelta(days=span), a - dt.timedelta(days=1))
        out["wow"] = sh(WOW_DAYS)
        out["yoy"] = sh(YOY_DAYS)
        return out


def filter_fact(df: DataFrame, ctx: TravelContext, with_dates: bool = True) -> DataFrame:
    """P5: flights / visas filter (origin = source market); travel type (any case)
    'domestic' = origin equals destination, 'international' = it does not, others are
    ignored."""
    if with_dates and ctx.date_from:
        df = df.filter(F.col("date") >= F.lit(ctx.date_from))
    if with_dates and ctx.date_to:
        df = df.filter(F.col("date") <= F.lit(ctx.date_to))
    if ctx.destination:
        df = df.filter(F.col("destination_id") == ctx.destination)
    if ctx.source_market:
        df = df.filter(F.col("origin_country") == ctx.source_market)
    tt = (ctx.travel_type or "").lower()
    if tt == "domestic":
        df = df.filter(F.col("origin_country") == F.col("destination_id"))
    elif tt == "international":
        df = df.filter(F.col("origin_country") != F.col("destination_id"))
    return df


def filter_metrics_ctx(fact: DataFrame, ctx: TravelContext, with_dates: bool = True) -> DataFrame:
    """Daily-metrics filter of the context; the crisis filter applies only when that
    crisis id occurs in the fact (J10, an EXISTS scalar subquery)."""
    if with_dates and ctx.date_from:
        fact = fact.filter(F.col("date") >= F.lit(ctx.date_from))
    if with_dates and ctx.date_to:
        fact = fact.filter(F.col("date") <= F.lit(ctx.date_to))
    for c, v in (("destination_id", ctx.destination), ("source_market", ctx.source_market),
                 ("travel_type", ctx.travel_type)):
        if v:
            fact = fact.filter(F.col(c) == v)
    if ctx.crisis_id is not None:
        fact = apply_crisis_if_present(fact, ctx.crisis_id)
    return fact


def apply_crisis_if_present(fact: DataFrame, crisis_id: int) -> DataFrame:
    """Keep rows of ``crisis_id`` only if the fact has that crisis at all."""
    present = fact.filter(F.col("crisis_id") == crisis_id).select(F.lit(1)).limit(1).exists()
    return fact.filter((~present) | (F.col("crisis_id") == crisis_id))


def _in(w):
    return (F.col("date") >= F.lit(w[0])) & (F.col("date") <= F.lit(w[1]))


def _span_filter(df, wins):
    if not wins:
        return df
    lo = min(w[0] for w in wins.values())
    hi = max(w[1] for w in wins.values())
    return df.filter((F.col("date") >= F.lit(lo)) & (F.col("date") <= F.lit(hi)))


def flight_totals(flights: DataFrame, ctx: TravelContext) -> DataFrame:
    """A34 + A38 + part of A39: one row of flight sums for the current window and its
    lead / previous windows, from one scan."""
    wins = {k: v for k, v in ctx.windows().items() if k in ("cur", "lead30", "lead60", "prev")}
    f = filter_fact(flights, ctx, with_dates=False)
    if not wins:
        f = filter_fact(flights, ctx)
        cur = F.lit(True)
        aggs = []
    else:
        f = _span_filter(f, wins)
        cur = _in(wins["cur"])
        aggs = [F.coalesce(F.sum(F.when(_in(w), F.col("flights_count"))), F.lit(0)).cast("double")
                .alias(f"flights_{k}") for k, w in wins.items() if k != "cur"]
    return f.agg(
        F.coalesce(F.sum(F.when(cur, F.col("flights_count"))), F.lit(0)).cast("double").alias("flights_total"),
        F.coalesce(F.sum(F.when(cur, F.col("seat_capacity"))), F.lit(0.0)).alias("seat_capacity"),
        F.coalesce(F.sum(F.when(cur, F.col("seat_capacity") * F.col("load_factor"))), F.lit(0.0)).alias("passengers"),
        F.coalesce(F.avg(F.when(cur, F.col("avg_airfare"))), F.lit(0.0)).alias("airfare_index"),
        *aggs)


def visa_totals(visas: DataFrame, ctx: TravelContext) -> DataFrame:
    """A35 + A38 + A40: visa sums for the current window, leads, previous period,
    week-over-week and year-over-year windows, from one scan."""
    wins = {k: v for k, v in ctx.windows().items() if k in ("cur", "lead15", "lead30", "prev", "wow", "yoy")}
    v = filter_fact(visas, ctx, with_dates=False)
    if not wins:
        v = filter_fact(visas, ctx)
        cur = F.lit(True)
        aggs = []
    else:
        v = _span_filter(v, wins)
        cur = _in(wins["cur"])
        aggs = [F.coalesce(F.sum(F.when(_in(w), F.col("visa_issued"))), F.lit(0)).cast("double")
                .alias(f"issued_{k}") for k, w in wins.items() if k != "cur"]
    return v.agg(
        F.coalesce(F.sum(F.when(cur, F.col("visa_applications"))), F.lit(0)).cast("double").alias("visa_applications"),
        F.coalesce(F.sum(F.when(cur, F.col("visa_issued"))), F.lit(0)).cast("double").alias("visa_issued"),
        F.coalesce(F.sum(F.when(cur, F.col("visa_rejected"))), F.lit(0)).cast("double").alias("visa_rejected"),
        F.coalesce(F.avg(F.when(cur, F.col("processing_days"))), F.lit(0.0)).alias("processing_time"),
        F.avg(F.when(cur, F.unix_date("date").cast("double"))).alias("avg_visa_day"),
        *aggs)


def booking_totals(fact: DataFrame, ctx: TravelContext) -> DataFrame:
    """A36 + part of A39: bookings and searches of the context and the previous
    period, from one scan of the daily fact."""
    wins = {k: v for k, v in ctx.windows().items() if k in ("cur", "prev")}
    m = filter_metrics_ctx(fact, ctx, with_dates=False)
    if not wins:
        m = filter_metrics_ctx(fact, ctx)
        cur, prev = F.lit(True), F.lit(False)
    else:
        m = _span_filter(m, wins)
        cur = _in(wins["cur"])
        prev = _in(wins["prev"]) if "prev" in wins else F.lit(False)
    return m.agg(
        F.coalesce(F.sum(F.when(cur, F.col("bookings"))), F.lit(0)).cast("double").alias("total_bookings"),
        F.coalesce(F.sum(F.when(cur, F.col("search_demand"))), F.lit(0.0)).alias("total_searches"),
        F.coalesce(F.sum(F.when(prev, F.col("bookings"))), F.lit(0)).cast("double").alias("bookings_prev"))


def bookings_daily(fact: DataFrame, ctx: TravelContext) -> DataFrame:
    """Daily bookings and room nights in the context."""
    return filter_metrics_ctx(fact, ctx).groupBy("date").agg(
        F.coalesce(F.sum("bookings"), F.lit(0)).alias("bookings"),
        F.coalesce(F.sum("room_nights"), F.lit(0.0)).alias("room_nights"))


def _growth(cur, prev):
    return F.when(prev != 0, safe_div(cur - prev, prev))


def trend_class(c) -> F.Column:
    """> 0.02 rising, < -0.02 declining, otherwise (or NULL) stable."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x > TREND_BAND, "rising").when(x < -TREND_BAND, "declining").otherwise("stable")


def demand_measures(flights: DataFrame, visas: DataFrame, fact: DataFrame, ctx: TravelContext) -> DataFrame:
    """The measures of the travel-demand payload in one row.

    The three one-row aggregates are combined with scalar subqueries (no join)."""
    ft = flight_totals(flights, ctx)
    vt = visa_totals(visas, ctx)
    bt = booking_totals(fact, ctx)
    bd = bookings_daily(fact, ctx)
    has_w = bool(ctx.windows())
    # One struct-valued scalar subquery per one-row aggregate: every measure of a fact
    # comes from the same subquery (evaluated once), not one re-scan per column.
    fts = ft.select(F.struct(*ft.columns).alias("s")).scalar()
    vts = vt.select(F.struct(*vt.columns).alias("s")).scalar()
    subs = {id(ft): fts, id(vt): vts}
    get = lambda df, c: subs[id(df)][c]
    zero = F.lit(0.0)
    flights_prev = get(ft, "flights_prev") if has_w else zero
    issued_prev = get(vt, "issued_prev") if has_w else zero
    base = bt.select(
        get(ft, "flights_total").alias("flights_total"), get(ft, "seat_capacity").alias("seat_capacity"),
        get(ft, "passengers").alias("passengers"), get(ft, "airfare_index").alias("airfare_index"),
        get(vt, "visa_applications").alias("visa_applications"), get(vt, "visa_issued").alias("visa_issued"),
        get(vt, "visa_rejected").alias("visa_rejected"), get(vt, "processing_time").alias("processing_time"),
        "total_bookings", "total_searches",
        (get(ft, "flights_lead30") if has_w else zero).alias("flight_lead_30d"),
        (get(ft, "flights_lead60") if has_w else zero).alias("flight_lead_60d"),
        (get(vt, "issued_lead15") if has_w else zero).alias("visa_lead_15d"),
        (get(vt, "issued_lead30") if has_w else zero).alias("visa_lead_30d"),
        flights_prev.alias("flights_prev"), issued_prev.alias("visa_issued_prev"),
        F.col("bookings_prev"),
        (get(vt, "issued_wow") if has_w else zero).alias("visa_issued_prev_week"),
        (get(vt, "issued_yoy") if has_w else zero).alias("visa_issued_last_year"),
        get(vt, "avg_visa_day").alias("_avg_visa_day"),
        bd.agg(F.avg(F.unix_date("date").cast("double"))).scalar().alias("_avg_booking_day"))
    c = F.col
    va, vi = c("visa_applications"), c("visa_issued")
    approval = safe_div(vi, va)
    fg = _growth(c("flights_total"), c("flights_prev"))
    vg = _growth(vi, c("visa_issued_prev"))
    bg = _growth(c("total_bookings"), c("bookings_prev"))
    out = base.withColumns({
        "load_factor_pct": safe_div("passengers", "seat_capacity") * 100,
        "visa_approval_rate_pct": approval * 100,
        "visa_rejection_rate_pct": (F.lit(1.0) - approval) * 100,
        "visa_to_booking_pct": safe_div("total_bookings", vi) * 100,
        "search_to_visa_pct": safe_div(va, "total_searches") * 100,
        "capacity_vs_demand_gap": c("seat_capacity") - c("total_bookings"),
        "flight_growth": fg, "visa_growth": vg, "booking_growth": bg,
        "visa_growth_wow": _growth(vi, c("visa_issued_prev_week")),
        "visa_growth_yoy": _growth(vi, c("visa_issued_last_year")),
        "booking_lag_from_visa": F.floor(c("_avg_booking_day") - c("_avg_visa_day")).cast("int"),
    })
    parts = [c("flight_growth"), c("visa_growth"), c("booking_growth")]
    n_nonnull = sum(F.when(p.isNotNull(), 1).otherwise(0) for p in parts)
    total = sum(F.coalesce(p, F.lit(0.0)) for p in parts)
    out = out.withColumns({
        "policy_impact_index": c("visa_growth"),
        "elasticity": F.when(c("booking_growth").isNotNull() & c("flight_growth").isNotNull(),
                             safe_div("booking_growth", "flight_growth")),
        "market_health_index": F.when(n_nonnull > 0, total / n_nonnull),
        "flight_trend": trend_class("flight_growth"),
        "market_state": market_state("flight_growth", "visa_growth", "booking_growth"),
    })
    return out.drop("_avg_visa_day", "_avg_booking_day")


def market_state(fg, vg, bg) -> F.Column:
    """The four-way market state rule (NULL growth counts as 0)."""
    f, v, b = (F.coalesce(F.col(x), F.lit(0.0)) for x in (fg, vg, bg))
    return (F.when((f > 0) & (v > 0) & (b >= 0), "constructive")
            .when((v < 0) & (b < 0), "slowdown")
            .when((f > 0) & (F.abs(b) < TREND_BAND), "divergence")
            .otherwise("mixed"))


def travel_funnel(measures: DataFrame) -> DataFrame:
    """Five funnel stages (int values); stay = bookings x 2.8."""
    c = F.col
    st = lambda i, n, v: F.struct(F.lit(i).alias("ord"), F.lit(n).alias("stage"),
                                  v.cast("bigint").alias("value"))
    return measures.select(F.explode(F.array(
        st(1, "Searches", c("total_searches")), st(2, "Visa applications", c("visa_applications")),
        st(3, "Flights (count)", c("flights_total")), st(4, "Bookings", c("total_bookings")),
        st(5, "Stay (room nights est.)", c("total_bookings") * STAY_NIGHTS_PER_BOOKING))).alias("s")).select("s.*")


def top_routes(flights: DataFrame, ctx: TravelContext, n: int = 15) -> DataFrame:
    """Top routes by flights (ties by route)."""
    g = filter_fact(flights, ctx).groupBy("route").agg(F.sum("flights_count").alias("flights_count"))
    return g.orderBy(F.col("flights_count").desc(), "route").limit(n)


def top_visa_origins(visas: DataFrame, ctx: TravelContext, n: int = 15) -> DataFrame:
    """Top origins by visa applications (ties by origin)."""
    g = filter_fact(visas, ctx).groupBy("origin_country").agg(F.sum("visa_applications").alias("visa_applications"))
    return g.orderBy(F.col("visa_applications").desc(), "origin_country").limit(n)


def monthly_load_factor(flights: DataFrame, ctx: TravelContext, last_n: int = 24) -> DataFrame:
    """Load factor % per month (2 decimals, 0 without seats), last ``last_n``
    months."""
    g = filter_fact(flights, ctx).groupBy(F.trunc("date", "month").alias("date")).agg(
        F.sum("seat_capacity").alias("sc"), F.sum(F.col("seat_capacity") * F.col("load_factor")).alias("pax"))
    g = g.select("date", F.coalesce(round_python(safe_div("pax", "sc") * 100, 2), F.lit(0.0)).alias("load_factor_pct"))
    return g.orderBy(F.col("date").desc()).limit(last_n)


def monthly_signals(flights: DataFrame, visas: DataFrame, fact: DataFrame, ctx: TravelContext) -> DataFrame:
    """Flights, visas issued and bookings per month, missing -> 0.  One union of
    (month, measure, value) rows and one ``groupBy(month)`` with conditional sums
    instead of two FULL OUTER joins."""
    f = filter_fact(flights, ctx).select(F.trunc("date", "month").alias("month"), F.lit("f").alias("m"),
                                         F.col("flights_count").cast("double").alias("v"))
    v = filter_fact(visas, ctx).select(F.trunc("date", "month").alias("month"), F.lit("v").alias("m"),
                                       F.col("visa_issued").cast("double").alias("v"))
    b = filter_metrics_ctx(fact, ctx).select(F.trunc("date", "month").alias("month"), F.lit("b").alias("m"),
                                             F.col("bookings").cast("double").alias("v"))
    u = f.unionByName(v).unionByName(b)
    return u.groupBy("month").agg(
        F.coalesce(F.sum(F.when(F.col("m") == "f", F.col("v"))), F.lit(0.0)).alias("flights_total"),
        F.coalesce(F.sum(F.when(F.col("m") == "v", F.col("v"))), F.lit(0.0)).alias("visa_issued"),
        F.coalesce(F.sum(F.when(F.col("m") == "b", F.col("v"))), F.lit(0.0)).alias("total_bookings"))


def shock_trend(flights: DataFrame, visas: DataFrame, fact: DataFrame, ctx: TravelContext,
                base_months: int = 3, last_n: int = 24) -> DataFrame:
    """Each monthly signal divided by the mean of its first min(3, n) months
    (zero base -> 0), the last 24 months; plus the mean of the shown values per signal
    (``*_baseline``).  Month-level frames are small (one row per month); the first and
    last months are picked with ranks over that month frame."""
    signals = {"visa": "visa_issued", "flight": "flights_total", "booking": "total_bookings"}
    months = monthly_signals(flights, visas, fact, ctx).dropna(subset=["month"])
    # one row: the list of months (bounded by the calendar), so every fact is read once
    one = months.agg(F.array_sort(F.collect_list(F.struct("month", *signals.values()))).alias("m")).filter(F.size("m") > 0)
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)
    one = one.withColumn("first", F.slice("m", 1, base_months)).withColumn(
        "last", F.slice("m", F.greatest(F.size("m") - last_n, F.lit(0)) + 1, last_n))
    one = one.withColumns({f"{k}_base": mean(F.col(f"first.{c}")) for k, c in signals.items()})
    relative = lambda base: lambda v: F.coalesce(F.when(base != 0, v / base), F.lit(0.0))
    one = one.withColumns({f"{k}_shown": F.transform(f"last.{c}", relative(F.col(f"{k}_base"))) for k, c in signals.items()})
    shown = one.select(F.posexplode("last.month").alias("i", "date"), *[f"{k}_shown" for k in signals],
                       *[mean(F.col(f"{k}_shown")).alias(f"{k}_baseline") for k in signals])
    return shown.select("date", *[F.get(f"{k}_shown", F.col("i")).alias(f"{k}_shock") for k in signals], *[f"{k}_baseline" for k in signals])


def seats_vs_bookings(flights: DataFrame, fact: DataFrame, ctx: TravelContext) -> DataFrame:
    """Seat capacity and bookings of the context as two labelled values (whole numbers,
    half to even); no rows without both dates."""
    if not ctx.windows():
        return fact.sparkSession.createDataFrame([], "label string, value double")
    seats = filter_fact(flights, ctx).agg(F.coalesce(F.sum("seat_capacity"), F.lit(0.0))).scalar()
    booked = filter_metrics_ctx(fact, ctx).agg(F.coalesce(F.sum("bookings"), F.lit(0)).cast("double").alias("b"))
    rows = booked.select(F.explode(F.array(F.struct(F.lit("Seat capacity").alias("label"), seats.alias("value")),
                                           F.struct(F.lit("Bookings").alias("label"), F.col("b").alias("value")))).alias("r"))
    return rows.select("r.label", round_python("r.value", 0).alias("value"))


def windowed_totals(df: DataFrame, windows: DataFrame, measures: dict) -> DataFrame:
    """J8 general form: totals of every window (window, date_from, date_to) that has rows
    in it, from the running totals of ``df`` (read once; no window is expanded)."""
    totals = running_totals(df, {"_rows": F.lit(1).cast("bigint"), **measures})
    return window_totals(totals, windows, ["_rows", *measures]).filter("_rows > 0").select("window", *measures)


def context_windows(spark: SparkSession, ctx: TravelContext) -> DataFrame:
    """The named windows of a context as a small frame (window, date_from, date_to)."""
    rows = [(k, a, b) for k, (a, b) in ctx.windows().items()]
    return spark.createDataFrame(rows, "window string, date_from date, date_to date")
