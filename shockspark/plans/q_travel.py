"""Catalogue entries: travel-demand funnel."""

from __future__ import annotations

from pyspark.sql import functions as F

from shockspark.operators import travel as TR
from shockspark.operators.cumulative import running_totals, window_totals
from shockspark.plans.catalog import register
from shockspark.plans.sqlkit import cols, d
from shockspark.sources import fixtures as fx
from shockspark.sources.fixture_sql import with_fixtures

# Request context of the test queries: a summer window after crisis 1.
CTX = TR.TravelContext.of("1998-06-01", "1998-08-31")
CTX_DEST = TR.TravelContext.of("1998-06-01", "1998-08-31", destination="NATION_19", travel_type="international")
W = CTX.windows()


def _between(name):
    a, b = W[name]
    return f"date BETWEEN {d(a)} AND {d(b)}"


def _measures_sql() -> str:
    cur = _between("cur")
    return f"""
ft AS (SELECT CAST(COALESCE(SUM(flights_count) FILTER (WHERE {cur}), 0) AS DOUBLE) AS flights_total,
  COALESCE(SUM(seat_capacity) FILTER (WHERE {cur}), 0.0) AS seat_capacity,
  COALESCE(SUM(seat_capacity * load_factor) FILTER (WHERE {cur}), 0.0) AS passengers,
  COALESCE(AVG(avg_airfare) FILTER (WHERE {cur}), 0.0) AS airfare_index,
  CAST(COALESCE(SUM(flights_count) FILTER (WHERE {_between('lead30')}), 0) AS DOUBLE) AS flight_lead_30d,
  CAST(COALESCE(SUM(flights_count) FILTER (WHERE {_between('lead60')}), 0) AS DOUBLE) AS flight_lead_60d,
  CAST(COALESCE(SUM(flights_count) FILTER (WHERE {_between('prev')}), 0) AS DOUBLE) AS flights_prev
  FROM fact_flights),
vt AS (SELECT CAST(COALESCE(SUM(visa_applications) FILTER (WHERE {cur}), 0) AS DOUBLE) AS visa_applications,
  CAST(COALESCE(SUM(visa_issued) FILTER (WHERE {cur}), 0) AS DOUBLE) AS visa_issued,
  CAST(COALESCE(SUM(visa_rejected) FILTER (WHERE {cur}), 0) AS DOUBLE) AS visa_rejected,
  COALESCE(AVG(processing_days) FILTER (WHERE {cur}), 0.0) AS processing_time,
  AVG(CAST(date_diff('day', DATE '1970-01-01', date) AS DOUBLE)) FILTER (WHERE {cur}) AS avg_visa_day,
  CAST(COALESCE(SUM(visa_issued) FILTER (WHERE {_between('lead15')}), 0) AS DOUBLE) AS visa_lead_15d,
  CAST(COALESCE(SUM(visa_issued) FILTER (WHERE {_between('lead30')}), 0) AS DOUBLE) AS visa_lead_30d,
  CAST(COALESCE(SUM(visa_issued) FILTER (WHERE {_between('prev')}), 0) AS DOUBLE) AS visa_issued_prev,
  CAST(COALESCE(SUM(visa_issued) FILTER (WHERE {_between('wow')}), 0) AS DOUBLE) AS visa_issued_prev_week,
  CAST(COALESCE(SUM(visa_issued) FILTER (WHERE {_between('yoy')}), 0) AS DOUBLE) AS visa_issued_last_year
  FROM fact_visas),
bt AS (SELECT CAST(COALESCE(SUM(bookings) FILTER (WHERE {cur}), 0) AS DOUBLE) AS total_bookings,
  COALESCE(SUM(search_demand) FILTER (WHERE {cur}), 0.0) AS total_searches,
  CAST(COALESCE(SUM(bookings) FILTER (WHERE {_between('prev')}), 0) AS DOUBLE) AS bookings_prev
  FROM daily_metrics),
bd AS (SELECT date, SUM(bookings) AS bookings FROM daily_metrics WHERE {cur} GROUP BY date),
ms0 AS (SELECT ft.*, vt.*, bt.*,
  (SELECT AVG(CAST(date_diff('day', DATE '1970-01-01', date) AS DOUBLE)) FROM bd) AS avg_booking_day,
  CASE WHEN flights_prev <> 0 THEN (flights_total - flights_prev) / flights_prev END AS flight_growth,
  CASE WHEN visa_issued_prev <> 0 THEN (visa_issued - visa_issued_prev) / visa_issued_prev END AS visa_growth,
  CASE WHEN bookings_prev <> 0 THEN (total_bookings - bookings_prev) / bookings_prev END AS booking_growth
  FROM ft, vt, bt),
ms AS (SELECT *, passengers / NULLIF(seat_capacity, 0) * 100 AS load_factor_pct,
  visa_issued / NULLIF(visa_applications, 0) * 100 AS visa_approval_rate_pct,
  (1.0 - visa_issued / NULLIF(visa_applications, 0)) * 100 AS visa_rejection_rate_pct,
  total_bookings / NULLIF(visa_issued, 0) * 100 AS visa_to_booking_pct,
  visa_applications / NULLIF(total_searches, 0) * 100 AS search_to_visa_pct,
  seat_capacity - total_bookings AS capacity_vs_demand_gap,
  CASE WHEN visa_issued_prev_week <> 0 THEN (visa_issued - visa_issued_prev_week) / visa_issued_prev_week END AS visa_growth_wow,
  CASE WHEN visa_issued_last_year <> 0 THEN (visa_issued - visa_issued_last_year) / visa_issued_last_year END AS visa_growth_yoy,
  CAST(floor(avg_booking_day - avg_visa_day) AS INTEGER) AS booking_lag_from_visa,
  visa_growth AS policy_impact_index,
  CASE WHEN booking_growth IS NOT NULL AND flight_growth IS NOT NULL THEN booking_growth / NULLIF(flight_growth, 0) END AS elasticity,
  CASE WHEN flight_growth IS NULL AND visa_growth IS NULL AND booking_growth IS NULL THEN NULL
    ELSE (COALESCE(flight_growth, 0) + COALESCE(visa_growth, 0) + COALESCE(booking_growth, 0))
      / ((flight_growth IS NOT NULL)::INT + (visa_growth IS NOT NULL)::INT + (booking_growth IS NOT NULL)::INT) END AS market_health_index,
  CASE WHEN flight_growth > 0.02 THEN 'rising' WHEN flight_growth < -0.02 THEN 'declining' ELSE 'stable' END AS flight_trend,
  CASE WHEN COALESCE(flight_growth, 0) > 0 AND COALESCE(visa_growth, 0) > 0 AND COALESCE(booking_growth, 0) >= 0 THEN 'constructive'
    WHEN COALESCE(visa_growth, 0) < 0 AND COALESCE(booking_growth, 0) < 0 THEN 'slowdown'
    WHEN COALESCE(flight_growth, 0) > 0 AND abs(COALESCE(booking_growth, 0)) < 0.02 THEN 'divergence' ELSE 'mixed' END AS market_state
  FROM ms0)"""


MEASURES_SQL = _measures_sql()


def _measures(spark, sf_dir, ctx=CTX):
    return TR.demand_measures(fx.fact_flights(spark, sf_dir), fx.fact_visas(spark, sf_dir),
                              fx.daily_metrics(spark, sf_dir), ctx)


def _subset(name, doc, colnames):
    sel = cols(*[c if c in ("booking_lag_from_visa", "flight_trend", "market_state") else f"{c}:d" for c in colnames])

    @register(name, with_fixtures(MEASURES_SQL, f"SELECT {sel} FROM ms"))
    def q(spark, sf_dir):
        return _measures(spark, sf_dir).select(*colnames)

    q.__doc__ = doc
    return q


_subset("a34_flight_totals", "A34: flights, seats, passengers, airfare and load factor.",
        ["flights_total", "seat_capacity", "passengers", "airfare_index", "load_factor_pct"])
_subset("a35_visa_totals", "A35: visa applications / issued / rejected, approval and rejection %.",
        ["visa_applications", "visa_issued", "visa_rejected", "visa_approval_rate_pct", "visa_rejection_rate_pct",
         "processing_time"])
_subset("a36_booking_totals", "A36: bookings and searches of the context.", ["total_bookings", "total_searches"])
_subset("a37_conversions", "A37: visa-to-booking %, search-to-visa %, seats - bookings gap.",
        ["visa_to_booking_pct", "search_to_visa_pct", "capacity_vs_demand_gap"])
_subset("a38_lead_windows", "A38: flight leads -30/-60 and visa leads -15/-30 days (J8 windows).",
        ["flight_lead_30d", "flight_lead_60d", "visa_lead_15d", "visa_lead_30d"])
_subset("a39_growth_and_health", "A39: growth vs the previous period, market health, elasticity.",
        ["flights_prev", "visa_issued_prev", "bookings_prev", "flight_growth", "visa_growth", "booking_growth",
         "market_health_index", "elasticity"])
_subset("a40_visa_growth", "A40: visa growth WoW / YoY and policy impact.",
        ["visa_issued_prev_week", "visa_issued_last_year", "visa_growth_wow", "visa_growth_yoy",
         "policy_impact_index"])
_subset("a44_booking_lag", "A44: booking lag from visa in whole days (floored).", ["booking_lag_from_visa"])
_subset("a45_market_state", "A45: flight trend class and the four-way market state.",
        ["flight_growth", "flight_trend", "market_state"])


@register("a41_travel_funnel", with_fixtures(MEASURES_SQL, """
SELECT 1 AS ord, 'Searches' AS stage, CAST(trunc(total_searches) AS BIGINT) AS value FROM ms
UNION ALL SELECT 2, 'Visa applications', CAST(trunc(visa_applications) AS BIGINT) FROM ms
UNION ALL SELECT 3, 'Flights (count)', CAST(trunc(flights_total) AS BIGINT) FROM ms
UNION ALL SELECT 4, 'Bookings', CAST(trunc(total_bookings) AS BIGINT) FROM ms
UNION ALL SELECT 5, 'Stay (room nights est.)', CAST(trunc(total_bookings * 2.8::DOUBLE) AS BIGINT) FROM ms"""))
def a41_travel_funnel(spark, sf_dir):
    """Five-stage travel funnel."""
    return TR.travel_funnel(_measures(spark, sf_dir))


@register("a42_monthly_load_factor", with_fixtures(f"""
g AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, SUM(seat_capacity) AS sc,
  SUM(seat_capacity * load_factor) AS pax FROM fact_flights WHERE {_between('cur')} GROUP BY 1)""", """
SELECT date, COALESCE(round(round_even(pax / NULLIF(sc, 0) * 100, 2), 6), 0.0) AS load_factor_pct FROM g ORDER BY date DESC LIMIT 24"""))
def a42_monthly_load_factor(spark, sf_dir):
    """Monthly load factor of the context, last 24 months."""
    return TR.monthly_load_factor(fx.fact_flights(spark, sf_dir), CTX)


@register("a42_monthly_load_factor_all", with_fixtures("""
g AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, SUM(seat_capacity) AS sc,
  SUM(seat_capacity * load_factor) AS pax FROM fact_flights GROUP BY 1)""", """
SELECT date, COALESCE(round(round_even(pax / NULLIF(sc, 0) * 100, 2), 6), 0.0) AS load_factor_pct FROM g ORDER BY date DESC LIMIT 24"""))
def a42_monthly_load_factor_all(spark, sf_dir):
    """Monthly load factor without a date filter (last 24 of all months)."""
    return TR.monthly_load_factor(fx.fact_flights(spark, sf_dir), TR.TravelContext())


SIG_SQL = """
u AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, 'f' AS m, CAST(flights_count AS DOUBLE) AS v FROM fact_flights
  UNION ALL SELECT CAST(date_trunc('month', date) AS DATE), 'v', CAST(visa_issued AS DOUBLE) FROM fact_visas
  UNION ALL SELECT CAST(date_trunc('month', date) AS DATE), 'b', CAST(bookings AS DOUBLE) FROM daily_metrics),
sig AS (SELECT month, COALESCE(SUM(v) FILTER (WHERE m = 'f'), 0.0) AS flights_total,
  COALESCE(SUM(v) FILTER (WHERE m = 'v'), 0.0) AS visa_issued, COALESCE(SUM(v) FILTER (WHERE m = 'b'), 0.0) AS total_bookings
  FROM u GROUP BY month)"""


@register("j5_monthly_signals", with_fixtures(SIG_SQL, """
SELECT month, round(flights_total, 6) AS flights_total, round(visa_issued, 6) AS visa_issued,
  round(total_bookings, 6) AS total_bookings FROM sig"""))
def j5_monthly_signals(spark, sf_dir):
    """Flights, visas, bookings by month (outer-merge semantics via union + group)."""
    return TR.monthly_signals(fx.fact_flights(spark, sf_dir), fx.fact_visas(spark, sf_dir),
                              fx.daily_metrics(spark, sf_dir), TR.TravelContext())


@register("a43_shock_trend", with_fixtures(SIG_SQL + """,
fb AS (SELECT AVG(flights_total) AS fb, AVG(visa_issued) AS vb, AVG(total_bookings) AS bb
  FROM (SELECT * FROM sig ORDER BY month LIMIT 3)),
shown AS (SELECT * FROM sig ORDER BY month DESC LIMIT 24),
s AS (SELECT month AS date, COALESCE(CASE WHEN vb <> 0 THEN visa_issued / vb END, 0.0) AS visa_shock,
  COALESCE(CASE WHEN fb <> 0 THEN flights_total / fb END, 0.0) AS flight_shock,
  COALESCE(CASE WHEN bb <> 0 THEN total_bookings / bb END, 0.0) AS booking_shock FROM shown, fb)""", """
SELECT date, round(visa_shock, 6) AS visa_shock, round(flight_shock, 6) AS flight_shock, round(booking_shock, 6) AS booking_shock,
  round((SELECT AVG(visa_shock) FROM s), 6) AS visa_baseline, round((SELECT AVG(flight_shock) FROM s), 6) AS flight_baseline,
  round((SELECT AVG(booking_shock) FROM s), 6) AS booking_baseline FROM s"""))
def a43_shock_trend(spark, sf_dir):
    """Monthly shock index (base = first 3 months), last 24 months."""
    return TR.shock_trend(fx.fact_flights(spark, sf_dir), fx.fact_visas(spark, sf_dir),
                          fx.daily_metrics(spark, sf_dir), TR.TravelContext())


@register("t2_top_routes", with_fixtures("", f"""
SELECT route, CAST(SUM(flights_count) AS BIGINT) AS flights_count FROM fact_flights WHERE {_between('cur')}
GROUP BY route ORDER BY flights_count DESC, route LIMIT 15"""))
def t2_top_routes(spark, sf_dir):
    """Top 15 routes by flights in the context."""
    return TR.top_routes(fx.fact_flights(spark, sf_dir), CTX)


@register("t2_top_visa_origins", with_fixtures("", f"""
SELECT origin_country, CAST(SUM(visa_applications) AS BIGINT) AS visa_applications FROM fact_visas WHERE {_between('cur')}
GROUP BY origin_country ORDER BY visa_applications DESC, origin_country LIMIT 15"""))
def t2_top_visa_origins(spark, sf_dir):
    """Top 15 origins by visa applications in the context."""
    return TR.top_visa_origins(fx.fact_visas(spark, sf_dir), CTX)


def _wins_values():
    return ", ".join(f"('{k}', {d(a)}, {d(b)})" for k, (a, b) in W.items())


@register("j8_windowed_flight_totals", with_fixtures(f"""
w AS (SELECT * FROM (VALUES {_wins_values()}) t(window_name, date_from, date_to))""", """
SELECT w.window_name AS window, CAST(COALESCE(SUM(f.flights_count), 0) AS BIGINT) AS flights,
  round(COALESCE(SUM(f.seat_capacity), 0), 6) AS seats
FROM fact_flights f JOIN w ON f.date BETWEEN w.date_from AND w.date_to GROUP BY w.window_name"""))
def j8_windowed_flight_totals(spark, sf_dir):
    """Totals of all shifted windows from running totals (one scan, two look-ups a window)."""
    wins = TR.context_windows(spark, CTX)
    return TR.windowed_totals(fx.fact_flights(spark, sf_dir), wins,
                              {"flights": F.col("flights_count").cast("bigint"), "seats": F.col("seat_capacity")})


@register("j8_trailing_windows", with_fixtures("""
ends AS (SELECT DISTINCT destination_id, date AS date_to FROM fact_flights),
daily AS (SELECT destination_id, date, SUM(flights_count) AS n, SUM(seat_capacity) AS s FROM fact_flights GROUP BY ALL),
lengths(days) AS (VALUES (7), (30), (90))""", """
SELECT e.destination_id, e.date_to, days, CAST(SUM(n) AS BIGINT) AS flights, round(SUM(s), 6) AS seats
FROM ends e, lengths, daily d WHERE d.destination_id = e.destination_id AND d.date <= e.date_to AND d.date > e.date_to - days
GROUP BY e.destination_id, e.date_to, days"""))
def j8_trailing_windows(spark, sf_dir):
    """The trailing 7, 30 and 90 days of every destination and day with flights, all from
    one table of running totals."""
    flights = fx.fact_flights(spark, sf_dir)
    ends = flights.select("destination_id", F.col("date").alias("date_to"), F.explode(F.array(*map(F.lit, (7, 30, 90)))).alias("days")).distinct()
    totals = running_totals(flights, {"flights": F.col("flights_count"), "seats": F.col("seat_capacity")}, ("destination_id",))
    windows = ends.withColumn("date_from", F.expr("date_add(date_to, 1 - days)"))
    return window_totals(totals, windows, ["flights", "seats"], ("destination_id",)).drop("date_from")


@register("j10_crisis_filter_present", with_fixtures("", """
SELECT CAST(SUM(bookings) AS BIGINT) AS bookings, COUNT(*) AS row_count FROM daily_metrics
WHERE date BETWEEN DATE '1998-06-01' AND DATE '1998-08-31' AND travel_type = 'international' AND total_reservations % 2 = 1"""))
def j10_crisis_filter_present(spark, sf_dir):
    """Crisis 2 occurs in a part of the fact, so the crisis filter applies."""
    ctx = TR.TravelContext.of("1998-06-01", "1998-08-31", crisis_id=2)
    part = (F.col("travel_type") == "international") & (F.col("total_reservations") % 2 == 1)
    fact = fx.daily_metrics(spark, sf_dir).withColumn("crisis_id", F.when(part, 2).otherwise(F.col("crisis_id")))
    m = TR.filter_metrics_ctx(fact, ctx)
    return m.agg(F.sum("bookings").alias("bookings"), F.count(F.lit(1)).alias("row_count"))


@register("j10_crisis_filter_absent", with_fixtures("", """
SELECT CAST(SUM(bookings) AS BIGINT) AS bookings, COUNT(*) AS row_count FROM daily_metrics
WHERE date BETWEEN DATE '1998-06-01' AND DATE '1998-08-31'
  AND (NOT EXISTS (SELECT 1 FROM daily_metrics WHERE crisis_id = 7) OR crisis_id = 7)"""))
def j10_crisis_filter_absent(spark, sf_dir):
    """Crisis 7 does not occur in the fact, so no crisis filter applies."""
    ctx = TR.TravelContext.of("1998-06-01", "1998-08-31", crisis_id=7)
    m = TR.filter_metrics_ctx(fx.daily_metrics(spark, sf_dir), ctx)
    return m.agg(F.sum("bookings").alias("bookings"), F.count(F.lit(1)).alias("row_count"))


@register("a36_bookings_daily", with_fixtures("", """
SELECT date, CAST(SUM(bookings) AS BIGINT) AS bookings, round(SUM(room_nights), 6) AS room_nights FROM daily_metrics
WHERE date BETWEEN DATE '1997-06-01' AND DATE '1998-08-31' AND destination_id = 'NATION_19' AND travel_type = 'international'
GROUP BY date"""))
def a36_bookings_daily(spark, sf_dir):
    """Daily bookings in a destination + travel-type context."""
    ctx = TR.TravelContext.of("1997-06-01", "1998-08-31", destination="NATION_19", travel_type="international")
    return TR.bookings_daily(fx.daily_metrics(spark, sf_dir), ctx)


@register("p5_travel_measures_filtered", with_fixtures(f"""
ft AS (SELECT CAST(COALESCE(SUM(flights_count), 0) AS DOUBLE) AS flights_total FROM fact_flights
  WHERE {_between('cur')} AND destination_id = 'NATION_19' AND origin_country <> destination_id),
vt AS (SELECT CAST(COALESCE(SUM(visa_issued), 0) AS DOUBLE) AS visa_issued FROM fact_visas
  WHERE {_between('cur')} AND destination_id = 'NATION_19' AND origin_country <> destination_id),
bt AS (SELECT CAST(COALESCE(SUM(bookings), 0) AS DOUBLE) AS total_bookings FROM daily_metrics
  WHERE {_between('cur')} AND destination_id = 'NATION_19' AND travel_type = 'international')""", """
SELECT round(flights_total, 6) AS flights_total, round(visa_issued, 6) AS visa_issued,
  round(total_bookings, 6) AS total_bookings FROM ft, vt, bt"""))
def p5_travel_measures_filtered(spark, sf_dir):
    """P5 in the payload: destination + international filter on all three facts."""
    return _measures(spark, sf_dir, CTX_DEST).select("flights_total", "visa_issued", "total_bookings")


@register("p7_travel_context_of_crisis", with_fixtures("", """
SELECT CAST(SUM(bookings) AS BIGINT) AS bookings, COUNT(DISTINCT date) AS days, MIN(date) AS first_day, MAX(date) AS last_day
FROM daily_metrics, crisis_events e WHERE e.crisis_id = 2 AND date BETWEEN e.crisis_start_date AND e.crisis_end_date"""))
def p7_travel_context_of_crisis(spark, sf_dir):
    """A request with a crisis and no dates runs over that crisis's dates."""
    ctx = TR.TravelContext.of(crisis_id=2).resolved(fx.crisis_events(spark))
    daily = TR.bookings_daily(fx.daily_metrics(spark, sf_dir), ctx)
    return daily.agg(F.sum("bookings").alias("bookings"), F.count(F.lit(1)).alias("days"), F.min("date").alias("first_day"),
                     F.max("date").alias("last_day"))


@register("a37_seats_vs_bookings", with_fixtures("", f"""
SELECT 'Seat capacity' AS label, round_even(SUM(seat_capacity), 0) AS value FROM fact_flights WHERE {_between('cur')}
UNION ALL SELECT 'Bookings', CAST(SUM(bookings) AS DOUBLE) FROM daily_metrics WHERE {_between('cur')}"""))
def a37_seats_vs_bookings(spark, sf_dir):
    """Seat capacity beside bookings."""
    return TR.seats_vs_bookings(fx.fact_flights(spark, sf_dir), fx.daily_metrics(spark, sf_dir), CTX)
