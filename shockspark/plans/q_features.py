"""Catalogue entries: daily aggregation and feature engineering (SURVEY A1, J2, J3,
F1-F7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shockspark.operators import features as FE
from shockspark.plans.catalog import register
from shockspark.plans.sqlkit import cols
from shockspark.sources import fixtures as fx
from shockspark.sources.fixture_sql import with_fixtures

CRISIS_START = "1998-06-01"

A1_SQL_BODY = """
a1 AS (SELECT arrival_date AS date, destination_id,
  COUNT(*) FILTER (WHERE is_canceled = 0) AS bookings, COUNT(*) FILTER (WHERE is_canceled = 1) AS cancellations,
  COUNT(is_canceled) AS total_reservations, AVG(adr) AS adr,
  CAST(SUM(COALESCE(stays_in_weekend_nights, 0) + COALESCE(stays_in_week_nights, 0)) AS BIGINT) AS room_nights
  FROM reservations GROUP BY arrival_date, destination_id)"""
A1_COLS = cols("date", "destination_id", "bookings", "cancellations", "total_reservations", "adr:d", "room_nights")


@register("a1_daily_aggregates", with_fixtures(A1_SQL_BODY, f"SELECT {A1_COLS} FROM a1"))
def a1_daily_aggregates(spark, sf_dir):
    """A1: reservations -> (date, destination) daily aggregate."""
    return FE.daily_aggregates(fx.reservations(spark, sf_dir))


SEARCH_SQL = """
srch AS (SELECT date, destination_id, SUM(search_demand) AS search_demand FROM daily_metrics GROUP BY date, destination_id)"""


def _searches(spark, sf_dir):
    return fx.daily_metrics(spark, sf_dir).groupBy("date", "destination_id").agg(
        F.sum("search_demand").alias("search_demand"))


@register("j2_attach_searches", with_fixtures(A1_SQL_BODY + "," + SEARCH_SQL, f"""
SELECT {A1_COLS}, round(s.search_demand, 6) AS search_demand
FROM a1 LEFT JOIN srch s USING (date, destination_id)"""))
def j2_attach_searches(spark, sf_dir):
    """LEFT join of searches onto the daily aggregate."""
    return FE.attach_searches(FE.daily_aggregates(fx.reservations(spark, sf_dir)), _searches(spark, sf_dir))


BASE_SQL = f"""
b0 AS (SELECT COUNT(*) FILTER (WHERE date >= DATE '1998-05-02' AND date < DATE '{CRISIS_START}') AS n_base,
  AVG(bookings) FILTER (WHERE date >= DATE '1998-05-02' AND date < DATE '{CRISIS_START}') AS b1,
  AVG(adr) FILTER (WHERE date >= DATE '1998-05-02' AND date < DATE '{CRISIS_START}') AS a1,
  AVG(bookings) FILTER (WHERE date < (SELECT MIN(date) FROM daily_metrics) + INTERVAL 30 DAY) AS b2,
  AVG(adr) FILTER (WHERE date < (SELECT MIN(date) FROM daily_metrics) + INTERVAL 30 DAY) AS a2
  FROM daily_metrics),
base AS (SELECT CASE WHEN (CASE WHEN n_base > 0 THEN b1 ELSE b2 END) > 0 THEN (CASE WHEN n_base > 0 THEN b1 ELSE b2 END) ELSE 1.0 END AS bb,
  CASE WHEN (CASE WHEN n_base > 0 THEN a1 ELSE a2 END) > 0 THEN (CASE WHEN n_base > 0 THEN a1 ELSE a2 END) ELSE 1.0 END AS ba FROM b0)"""


@register("f1_global_baseline", with_fixtures(BASE_SQL, "SELECT round(bb, 6) AS baseline_bookings, round(ba, 6) AS baseline_adr FROM base"))
def f1_global_baseline(spark, sf_dir):
    """global pre-crisis baseline (30 days before 1998-06-01)."""
    return FE.global_baseline(fx.daily_metrics(spark, sf_dir), CRISIS_START, 30)


FEAT_SQL = BASE_SQL + f""",
feat AS (SELECT m.date, m.destination_id, m.source_market, 1 AS crisis_id, m.bookings, m.cancellations, m.total_reservations,
  m.search_demand, m.adr, m.room_nights, m.avg_length_of_stay, m.travel_type, m.lead_time_days, m.occupancy_rate,
  CAST(m.bookings AS DOUBLE) AS bookings_per_day,
  CASE WHEN m.total_reservations > 0 THEN m.cancellations / m.total_reservations ELSE 0.0 END AS cancellation_rate,
  CASE WHEN m.bookings > 0 THEN (CASE WHEN COALESCE(m.search_demand, 0) / m.bookings > 1000 THEN 1000.0
       ELSE COALESCE(m.search_demand, 0) / m.bookings END) END AS search_to_booking_ratio,
  (m.adr - base.ba) / base.ba * 100 AS adr_change,
  (m.bookings - base.bb) / base.bb * 100 AS demand_change_percent,
  m.bookings / base.bb * 100 AS normalized_demand_index,
  CASE WHEN date_diff('day', DATE '{CRISIS_START}', m.date) < 0 THEN 'pre_crisis'
       WHEN date_diff('day', DATE '{CRISIS_START}', m.date) <= 14 THEN 'immediate'
       WHEN date_diff('day', DATE '{CRISIS_START}', m.date) <= 90 THEN 'short_term' ELSE 'recovery' END AS crisis_phase,
  CAST(GREATEST(date_diff('day', DATE '{CRISIS_START}', m.date), 0) AS INTEGER) AS days_since_crisis
  FROM daily_metrics m, base)"""
FEAT_COLS = cols("date", "destination_id", "source_market", "crisis_id", "bookings", "cancellations",
                 "total_reservations", "search_demand:d", "adr:d", "room_nights:d", "avg_length_of_stay:d",
                 "travel_type", "lead_time_days", "occupancy_rate:d", "bookings_per_day:d", "cancellation_rate:d",
                 "search_to_booking_ratio:d", "adr_change:d", "demand_change_percent:d",
                 "normalized_demand_index:d", "crisis_phase", "days_since_crisis")


def engineered_fact(spark, sf_dir):
    return FE.engineer_features(fx.daily_metrics(spark, sf_dir), 1, CRISIS_START, 30)


@register("f4_engineer_features", with_fixtures(FEAT_SQL, f"SELECT {FEAT_COLS} FROM feat"))
def f4_engineer_features(spark, sf_dir):
    """Engineered features with the global baseline and crisis phases."""
    return engineered_fact(spark, sf_dir)


@register("f5_no_crisis_features", with_fixtures(A1_SQL_BODY + "," + SEARCH_SQL, f"""
SELECT {A1_COLS}, round(s.search_demand, 6) AS search_demand, CAST(a1.bookings AS DOUBLE) AS bookings_per_day,
  round(CASE WHEN total_reservations > 0 THEN cancellations / total_reservations ELSE 0.0 END, 6) AS cancellation_rate,
  round(CASE WHEN bookings > 0 THEN COALESCE(s.search_demand, 0) / bookings END, 6) AS search_to_booking_ratio,
  CAST(NULL AS DOUBLE) AS adr_change, CAST(NULL AS DOUBLE) AS demand_change_percent, 100.0::DOUBLE AS normalized_demand_index,
  'pre_crisis' AS crisis_phase, 0 AS days_since_crisis, 0 AS crisis_id
FROM a1 LEFT JOIN srch s USING (date, destination_id)"""))
def f5_no_crisis_features(spark, sf_dir):
    """the no-crisis variant over the daily aggregate with searches."""
    daily = FE.attach_searches(FE.daily_aggregates(fx.reservations(spark, sf_dir)), _searches(spark, sf_dir))
    return FE.no_crisis_features(daily)


@register("f7_search_proxy", with_fixtures("""
db AS (SELECT destination_id, arrival_date AS date, COUNT(*) FILTER (WHERE is_canceled = 0) AS bookings
  FROM reservations GROUP BY destination_id, arrival_date),
la AS (SELECT *, LEAD(bookings, 7) OVER (PARTITION BY destination_id ORDER BY date) AS ah FROM db),
ff AS (SELECT *, LAST_VALUE(ah IGNORE NULLS) OVER (PARTITION BY destination_id ORDER BY date
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM la)""", """
SELECT date, destination_id, round(round(GREATEST(CAST(COALESCE(filled, bookings) AS DOUBLE), 1.0), 2), 6) AS search_demand FROM ff"""))
def f7_search_proxy(spark, sf_dir):
    """search proxy from bookings 7 rows ahead, forward-filled, floor 1."""
    return FE.search_proxy(fx.reservations(spark, sf_dir), 7)
