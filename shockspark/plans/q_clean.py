"""Catalogue entries: request filters and crisis lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from shockspark.operators import filters as FL
from shockspark.operators import windows as WN
from shockspark.plans.catalog import register
from shockspark.plans.sqlkit import cols
from shockspark.sources import fixtures as fx
from shockspark.sources.fixture_sql import with_fixtures

FACT_COLS = cols("date", "destination_id", "source_market", "crisis_id", "bookings", "cancellations",
                 "total_reservations", "search_demand:d", "adr:d", "room_nights:d", "avg_length_of_stay:d",
                 "travel_type", "lead_time_days", "occupancy_rate:d")


@register("p4_filter_metrics", with_fixtures("", f"""
SELECT {FACT_COLS} FROM daily_metrics
WHERE date >= DATE '1997-01-01' AND date <= DATE '1998-12-31' AND travel_type = 'international'"""))
def p4_filter_metrics(spark, sf_dir):
    """Date range + travel type filter on the fact (pushed to the scan)."""
    return FL.filter_metrics(fx.daily_metrics(spark, sf_dir), "1997-01-01", "1998-12-31",
                             travel_type="international")


@register("p4_filter_destination_market", with_fixtures("", f"""
SELECT {FACT_COLS} FROM daily_metrics WHERE destination_id = 'NATION_3' AND source_market = 'NATION_19'"""))
def p4_filter_destination_market(spark, sf_dir):
    """Destination and source-market filter."""
    return FL.filter_metrics(fx.daily_metrics(spark, sf_dir), destination="NATION_3", source_market="NATION_19")


FLIGHT_COLS = cols("date", "origin_country", "destination_id", "route", "flights_count", "seat_capacity:d",
                   "load_factor:d", "avg_airfare:d", "airline")


@register("p5_filter_facts_domestic", with_fixtures("", f"""
SELECT {FLIGHT_COLS} FROM fact_flights
WHERE date >= DATE '1996-01-01' AND date <= DATE '1997-12-31' AND origin_country = destination_id"""))
def p5_filter_facts_domestic(spark, sf_dir):
    """P5: flights filter, travel type 'domestic' = origin equals destination."""
    return FL.filter_facts(fx.fact_flights(spark, sf_dir), "1996-01-01", "1997-12-31", travel_type="domestic")


PREPOST_SQL = """
SELECT CASE WHEN date < {start} THEN 'pre' ELSE 'post' END AS period,
  CAST(SUM(bookings) AS BIGINT) AS bookings, COUNT(*) AS row_count
FROM daily_metrics GROUP BY 1"""


def _split_at(fact, start_col_scalar):
    return fact.groupBy(F.when(F.col("date") < start_col_scalar, "pre").otherwise("post").alias("period")).agg(
        F.sum("bookings").alias("bookings"), F.count(F.lit(1)).alias("row_count"))


@register("p5_filter_facts_type_case", with_fixtures("", f"""
SELECT {FLIGHT_COLS} FROM fact_flights WHERE date >= DATE '1996-01-01' AND origin_country <> destination_id"""))
def p5_filter_facts_type_case(spark, sf_dir):
    """P5: the travel type in any case; an open end date."""
    return FL.filter_facts(fx.fact_flights(spark, sf_dir), "1996-01-01", travel_type="InterNational")


@register("p6_unknown_crisis_fallback", with_fixtures("", PREPOST_SQL.format(
    start="(SELECT MIN(crisis_start_date) FROM crisis_events)")))
def p6_unknown_crisis_fallback(spark, sf_dir):
    """Crisis 99 is unknown -> the earliest crisis; fact split at its start."""
    c = WN.lookup_crisis(fx.crisis_events(spark), 99)
    return _split_at(fx.daily_metrics(spark, sf_dir), c.select("crisis_start_date").scalar())


@register("p6_crisis_by_id", with_fixtures("", PREPOST_SQL.format(
    start="(SELECT crisis_start_date FROM crisis_events WHERE crisis_id = 3)")))
def p6_crisis_by_id(spark, sf_dir):
    """Crisis 3 by id; fact split at its start."""
    c = WN.lookup_crisis(fx.crisis_events(spark), 3)
    return _split_at(fx.daily_metrics(spark, sf_dir), c.select("crisis_start_date").scalar())


@register("p7_effective_window_totals", with_fixtures("", """
SELECT destination_id, CAST(SUM(bookings) AS BIGINT) AS bookings, COUNT(*) AS row_count FROM daily_metrics
WHERE date >= (SELECT crisis_start_date FROM crisis_events WHERE crisis_id = 2)
  AND date <= (SELECT crisis_end_date FROM crisis_events WHERE crisis_id = 2)
GROUP BY destination_id"""))
def p7_effective_window_totals(spark, sf_dir):
    """The effective window of crisis 2 (its own start and end) applied to the fact."""
    w = WN.effective_window(fx.crisis_events(spark), 2)
    f = fx.daily_metrics(spark, sf_dir)
    f = f.filter((F.col("date") >= w.select("window_start").scalar()) &
                 (F.col("date") <= w.select("window_end").scalar()))
    return f.groupBy("destination_id").agg(F.sum("bookings").alias("bookings"), F.count(F.lit(1)).alias("row_count"))


@register("p7_explicit_dates_win", with_fixtures("", """
SELECT destination_id, CAST(SUM(bookings) AS BIGINT) AS bookings, COUNT(*) AS row_count FROM daily_metrics
WHERE date >= DATE '1999-01-01' AND date <= DATE '1999-03-31'
GROUP BY destination_id"""))
def p7_explicit_dates_win(spark, sf_dir):
    """Explicit dates override the crisis dates."""
    w = WN.effective_window(fx.crisis_events(spark), 2, "1999-01-01", "1999-03-31")
    f = fx.daily_metrics(spark, sf_dir)
    f = f.filter((F.col("date") >= w.select("window_start").scalar()) &
                 (F.col("date") <= w.select("window_end").scalar()))
    return f.groupBy("destination_id").agg(F.sum("bookings").alias("bookings"), F.count(F.lit(1)).alias("row_count"))


@register("p8_crisis_preset_range", with_fixtures("", """
SELECT destination_id, CAST(SUM(bookings) AS BIGINT) AS bookings, COUNT(*) AS row_count FROM daily_metrics
WHERE date >= DATE '1998-03-01' AND date <= DATE '1998-09-01' GROUP BY destination_id"""))
def p8_crisis_preset_range(spark, sf_dir):
    """UI preset (crisis 1 start -/+ 3 months) applied to the fact."""
    p = WN.crisis_presets(fx.crisis_events(spark), 3).filter(F.col("crisis_id") == 1)
    f = fx.daily_metrics(spark, sf_dir)
    f = f.filter((F.col("date") >= p.select("date_from").scalar()) & (F.col("date") <= p.select("date_to").scalar()))
    return f.groupBy("destination_id").agg(F.sum("bookings").alias("bookings"), F.count(F.lit(1)).alias("row_count"))


@register("p9_latest_matching_crisis", with_fixtures("", PREPOST_SQL.format(
    start="(SELECT MAX(crisis_start_date) FROM crisis_events WHERE lower(crisis_name || coalesce(affected_regions, '')) LIKE '%region_1%')")))
def p9_latest_matching_crisis(spark, sf_dir):
    """The newest crisis matching 'region_1' (name or regions, any case; the newest
    crisis of all does not match); fact split at it."""
    c = WN.latest_crisis_matching(fx.crisis_events(spark), "region_1")
    return _split_at(fx.daily_metrics(spark, sf_dir), c.select("crisis_start_date").scalar())


@register("p10_period_pre", with_fixtures("", """
SELECT destination_id, CAST(SUM(bookings) AS BIGINT) AS bookings, COUNT(*) AS row_count FROM daily_metrics
WHERE date < DATE '1998-06-01' GROUP BY destination_id"""))
def p10_period_pre(spark, sf_dir):
    """P10: the 'pre' period around 1998-06-01."""
    f = FL.period_filter(fx.daily_metrics(spark, sf_dir), "1998-06-01", "pre")
    return f.groupBy("destination_id").agg(F.sum("bookings").alias("bookings"), F.count(F.lit(1)).alias("row_count"))


@register("p11_latest_rows", with_fixtures("", f"""
SELECT {FACT_COLS} FROM daily_metrics ORDER BY date DESC, destination_id, source_market, crisis_id LIMIT 5000"""))
def p11_latest_rows(spark, sf_dir):
    """The newest 5000 fact rows (explicit order)."""
    return FL.latest_rows(fx.daily_metrics(spark, sf_dir), 5000)


@register("j7_crises_active_on_dates", with_fixtures("", """
SELECT d.date, c.crisis_id, c.crisis_name
FROM (SELECT DISTINCT date FROM daily_metrics) d
JOIN crisis_events c ON c.crisis_start_date <= d.date AND (c.crisis_end_date IS NULL OR c.crisis_end_date >= d.date)"""))
def j7_crises_active_on_dates(spark, sf_dir):
    """Crises active on each fact date (days of the crises, equi-join)."""
    dates = fx.daily_metrics(spark, sf_dir).select("date").distinct()
    return WN.crises_active_on(dates, fx.crisis_events(spark)).select("date", "crisis_id", "crisis_name")
