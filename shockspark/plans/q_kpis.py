"""Catalogue entries: fact summaries and stakeholder KPIs (SURVEY A15-A26, A29-A33,
A46-A48, A51, A52, X8, X9)."""

from __future__ import annotations

from shockspark.functions.exprs import to_fixed
from shockspark.operators import kpis as KP
from shockspark.plans.catalog import register
from shockspark.plans.sqlkit import cols
from shockspark.sources import fixtures as fx
from shockspark.sources.fixture_sql import with_fixtures

CRISIS_DATE = "1998-06-01"


def _fact(spark, sf_dir):
    return fx.daily_metrics(spark, sf_dir)


@register("a15_summary", with_fixtures("", """
SELECT MIN(date) AS date_min, MAX(date) AS date_max, CAST(SUM(bookings) AS BIGINT) AS total_bookings,
  CAST(trunc(SUM(room_nights)) AS BIGINT) AS total_room_nights, COUNT(DISTINCT destination_id) AS destinations_count,
  COUNT(*) AS records_count FROM daily_metrics"""))
def a15_summary(spark, sf_dir):
    """One-row summary of the fact."""
    return KP.summary(_fact(spark, sf_dir))


TL_SQL = """
tl AS (SELECT date, CAST(SUM(bookings) AS BIGINT) AS bookings, SUM(search_demand) AS search_demand, AVG(adr) AS adr,
  SUM(room_nights) AS room_nights FROM daily_metrics GROUP BY date)"""


@register("a16_timeline", with_fixtures(TL_SQL, f"SELECT {cols('date', 'bookings', 'search_demand:d', 'adr:d', 'room_nights:d')} FROM tl"))
def a16_timeline(spark, sf_dir):
    """Timeline by date."""
    return KP.timeline(_fact(spark, sf_dir))


@register("a17_monthly_by_destination", with_fixtures("", """
SELECT CAST(date_trunc('month', date) AS DATE) AS date, destination_id, CAST(SUM(bookings) AS BIGINT) AS bookings
FROM daily_metrics GROUP BY 1, 2"""))
def a17_monthly_by_destination(spark, sf_dir):
    """Month x destination bookings."""
    return KP.monthly_by_destination(_fact(spark, sf_dir))


@register("a18_monthly_bookings", with_fixtures("", """
SELECT strftime(date, '%Y-%m') AS month, CAST(SUM(bookings) AS BIGINT) AS bookings FROM daily_metrics GROUP BY 1"""))
def a18_monthly_bookings(spark, sf_dir):
    """Monthly bookings."""
    return KP.monthly_bookings(_fact(spark, sf_dir))


@register("a19_funnel", with_fixtures("""
t AS (SELECT CAST(trunc(SUM(search_demand)) AS BIGINT) AS s, CAST(SUM(bookings) AS BIGINT) AS b,
  CAST(SUM(cancellations) AS BIGINT) AS c FROM daily_metrics),
t2 AS (SELECT *, CAST(trunc(b * 1.3::DOUBLE) AS BIGINT) AS p FROM t),
st AS (SELECT 1 AS stage, 'Search Volume' AS name, s AS value, CAST(NULL AS BIGINT) AS prev FROM t2
  UNION ALL SELECT 2, 'Prebooks', p, s FROM t2 UNION ALL SELECT 3, 'Room Night Bookings', b, p FROM t2
  UNION ALL SELECT 4, 'Cancellations', c, b FROM t2)""", """
SELECT stage, name, value, CASE WHEN prev > 0 THEN round(value / prev * 100, 1) END AS conversion_pct,
  CASE WHEN prev > 0 THEN round((prev - value) / prev * 100, 1) END AS drop_off_pct FROM st"""))
def a19_funnel(spark, sf_dir):
    """4-stage demand funnel with conversion and drop-off."""
    return KP.funnel(_fact(spark, sf_dir))


def _side(flag, p):
    return f"""CAST(COALESCE(SUM(bookings) FILTER (WHERE {flag}), 0) AS BIGINT) AS {p}_bookings,
  COALESCE(AVG(adr) FILTER (WHERE {flag}), 0.0) AS {p}_adr,
  CAST(trunc(COALESCE(SUM(search_demand) FILTER (WHERE {flag}), 0)) AS BIGINT) AS {p}_search,
  CAST(trunc(COALESCE(SUM(room_nights) FILTER (WHERE {flag}), 0)) AS BIGINT) AS {p}_room_nights,
  COALESCE(AVG(occupancy_rate) FILTER (WHERE {flag}), 0.0) AS {p}_occupancy,
  CAST(COALESCE(SUM(cancellations) FILTER (WHERE {flag}), 0) AS BIGINT) AS {p}_cancellations"""


@register("a20_prepost_totals", with_fixtures(f"""
t AS (SELECT {_side(f"date < DATE '{CRISIS_DATE}'", 'pre')}, {_side(f"date >= DATE '{CRISIS_DATE}'", 'post')}
  FROM daily_metrics)""", f"""
SELECT {cols('pre_bookings', 'pre_adr:d', 'pre_search', 'pre_room_nights', 'pre_occupancy:d', 'pre_cancellations',
             'post_bookings', 'post_adr:d', 'post_search', 'post_room_nights', 'post_occupancy:d', 'post_cancellations')},
  round(CASE WHEN pre_bookings <> 0 THEN (post_bookings - pre_bookings) / abs(pre_bookings) * 100 END, 6) AS bookings_change_pct,
  round(CASE WHEN pre_room_nights <> 0 THEN (post_room_nights - pre_room_nights) / abs(pre_room_nights) * 100 END, 6) AS room_nights_change_pct,
  round(CASE WHEN pre_adr <> 0 THEN (post_adr - pre_adr) / abs(pre_adr) * 100 END, 6) AS adr_change_pct,
  round(CASE WHEN pre_search <> 0 THEN (post_search - pre_search) / abs(pre_search) * 100 END, 6) AS search_change_pct
FROM t"""))
def a20_prepost_totals(spark, sf_dir):
    """All-history totals before / from the crisis date with % changes."""
    return KP.prepost_totals(_fact(spark, sf_dir), CRISIS_DATE)


@register("a21_corridor_matrix", with_fixtures(f"""
c AS (SELECT source_market AS source, destination_id AS destination,
  CAST(COALESCE(SUM(bookings) FILTER (WHERE date < DATE '{CRISIS_DATE}'), 0) AS DOUBLE) AS bookings_pre,
  CAST(COALESCE(SUM(bookings) FILTER (WHERE date >= DATE '{CRISIS_DATE}'), 0) AS DOUBLE) AS bookings_post,
  COALESCE(SUM(search_demand) FILTER (WHERE date < DATE '{CRISIS_DATE}'), 0.0) AS search_pre,
  COALESCE(SUM(search_demand) FILTER (WHERE date >= DATE '{CRISIS_DATE}'), 0.0) AS search_post
  FROM daily_metrics GROUP BY 1, 2)""", f"""
SELECT {cols('source', 'destination', 'bookings_pre:d', 'bookings_post:d', 'search_pre:d', 'search_post:d')},
  round(CASE WHEN bookings_pre > 0 THEN (bookings_post - bookings_pre) / bookings_pre * 100 ELSE 0.0 END, 6) AS change_pct FROM c"""))
def a21_corridor_matrix(spark, sf_dir):
    """Corridor matrix (source market x destination) before / after."""
    return KP.corridor_matrix(_fact(spark, sf_dir), CRISIS_DATE)


HK_SQL = """
hk0 AS (SELECT destination_id, AVG(occupancy_rate) AS occupancy_rate, AVG(adr) AS adr, AVG(adr * occupancy_rate) AS revpar,
  CAST(SUM(bookings) AS BIGINT) AS bookings, CAST(SUM(cancellations) AS BIGINT) AS cancellations,
  CAST(SUM(total_reservations) AS BIGINT) AS total_reservations, SUM(search_demand) AS search_demand
  FROM daily_metrics GROUP BY destination_id),
hk AS (SELECT *, CASE WHEN total_reservations > 0 THEN cancellations / total_reservations ELSE 0.0 END AS cancellation_rate,
  CASE WHEN (SELECT SUM(bookings) FROM hk0) > 0 THEN bookings / (SELECT SUM(bookings) FROM hk0) * 100 ELSE 0.0 END
    AS market_demand_index FROM hk0)"""
HK_COLS = cols("destination_id", "occupancy_rate:d", "adr:d", "revpar:d", "bookings", "cancellations",
               "total_reservations", "search_demand:d", "cancellation_rate:d", "market_demand_index:d")


@register("a22_hotel_kpis", with_fixtures(HK_SQL, f"SELECT {HK_COLS} FROM hk"))
def a22_hotel_kpis(spark, sf_dir):
    """Hotel-chain KPIs per destination."""
    return KP.hotel_kpis(_fact(spark, sf_dir))


@register("a23_hotel_rollup", with_fixtures(HK_SQL, """
SELECT round(AVG(adr), 6) AS avg_adr, round(AVG(occupancy_rate), 6) AS avg_occupancy, round(AVG(revpar), 6) AS avg_revpar,
  CAST(SUM(bookings) AS BIGINT) AS total_bookings, round(AVG(cancellation_rate), 6) AS avg_cancellation_rate,
  round(AVG(market_demand_index), 6) AS avg_demand_index, round(AVG(revpar) * 0.4, 6) AS goppar,
  (SELECT destination_id FROM hk ORDER BY market_demand_index DESC, destination_id LIMIT 1) AS highest_demand_market,
  (SELECT destination_id FROM hk ORDER BY cancellation_rate DESC, destination_id LIMIT 1) AS highest_cancellation_risk
FROM hk"""))
def a23_hotel_rollup(spark, sf_dir):
    """Hotel roll-up (means, GOPPAR, top markets)."""
    return KP.hotel_rollup(KP.hotel_kpis(_fact(spark, sf_dir)))


OTA_SQL = """
o0 AS (SELECT destination_id, SUM(search_demand) AS search_demand, CAST(SUM(bookings) AS BIGINT) AS bookings,
  AVG(lead_time_days) AS avg_lead_time_days FROM daily_metrics GROUP BY destination_id),
ota AS (SELECT *, CASE WHEN search_demand > 0 THEN bookings / search_demand END AS conversion_rate,
  CASE WHEN (SELECT SUM(search_demand) FROM o0) > 0 THEN search_demand / (SELECT SUM(search_demand) FROM o0) * 100 ELSE 0.0 END
    AS market_share_pct FROM o0)"""


@register("a24_ota_kpis", with_fixtures(OTA_SQL, f"""
SELECT {cols('destination_id', 'search_demand:d', 'bookings', 'avg_lead_time_days:d', 'conversion_rate:d', 'market_share_pct:d')} FROM ota"""))
def a24_ota_kpis(spark, sf_dir):
    """OTA KPIs per destination."""
    return KP.ota_kpis(_fact(spark, sf_dir))


@register("t4_top12_market_share", with_fixtures(OTA_SQL, """
SELECT destination_id, round(market_share_pct, 2) AS market_share_pct FROM ota WHERE market_share_pct > 0
ORDER BY market_share_pct DESC, destination_id LIMIT 12"""))
def t4_top12_market_share(spark, sf_dir):
    """T4: the 12 largest market shares (2 decimals)."""
    from pyspark.sql import functions as F

    o = KP.ota_kpis(_fact(spark, sf_dir)).filter(F.col("market_share_pct") > 0)
    return o.orderBy(F.col("market_share_pct").desc(), "destination_id").limit(12).select(
        "destination_id", to_fixed("market_share_pct", 2).alias("market_share_pct"))


@register("a25_ota_rollup", with_fixtures(TL_SQL + """,
t AS (SELECT SUM(search_demand) AS s, CAST(SUM(bookings) AS BIGINT) AS b, COUNT(DISTINCT destination_id) AS n FROM daily_metrics),
a AS (SELECT AVG(adr) AS avg_adr FROM tl)""", """
SELECT round(s, 6) AS total_search_demand, b AS total_bookings, round(avg_adr, 6) AS avg_adr, round(b * avg_adr, 6) AS gbv,
  round(b * avg_adr * 0.15, 6) AS net_revenue, 15.0::DOUBLE AS take_rate_pct,
  round(CASE WHEN b <> 0 THEN s / b ELSE 0.0 END, 6) AS look_to_book,
  round(CASE WHEN s <> 0 THEN b / s * 100 ELSE 0.0 END, 6) AS conversion_pct, round(s * 3, 6) AS unique_visitors,
  n * 50 AS active_listings,
  (SELECT destination_id FROM daily_metrics GROUP BY destination_id ORDER BY SUM(search_demand) DESC, destination_id LIMIT 1) AS top_market
FROM t, a"""))
def a25_ota_rollup(spark, sf_dir):
    """OTA roll-up (GBV, net revenue, look-to-book, conversion, visitors, listings)."""
    return KP.ota_rollup(_fact(spark, sf_dir))


@register("a26_daily_ratios", with_fixtures(TL_SQL, """
SELECT date, bookings, round(search_demand, 6) AS search_demand,
  CASE WHEN bookings > 0 THEN round(round(COALESCE(search_demand, 0) / bookings, 2), 6) END AS look_to_book,
  round(CASE WHEN search_demand > 0 THEN bookings / search_demand * 100 ELSE 0.0 END, 6) AS conversion_pct FROM tl"""))
def a26_daily_ratios(spark, sf_dir):
    """Daily look-to-book and conversion."""
    return KP.daily_ratios(_fact(spark, sf_dir))


def _hist_sql(expr, src_where, bins, first_closed=False):
    parts = []
    for i, (lo, hi, label) in enumerate(bins):
        low = f"v >= {lo}" if (first_closed and i == 0) else f"v > {lo}"
        cond = low if hi is None else f"{low} AND v <= {hi}"
        parts.append(f"SELECT {i + 1} AS bin, '{label}' AS category, COUNT(*) FILTER (WHERE {cond}) AS count FROM vals")
    return with_fixtures(f"vals AS (SELECT {expr} AS v FROM daily_metrics WHERE {src_where}),\nh AS (" +
                         "\n UNION ALL ".join(parts) + ")", """
SELECT bin, category, count, CASE WHEN (SELECT SUM(count) FROM h) > 0
  THEN round_even(count / (SELECT SUM(count) FROM h) * 100, 1) ELSE 0.0 END AS pct FROM h""")


@register("a29_length_of_stay_histogram", _hist_sql("avg_length_of_stay", "avg_length_of_stay IS NOT NULL", KP.LOS_BINS))
def a29_length_of_stay_histogram(spark, sf_dir):
    """Length-of-stay histogram."""
    return KP.length_of_stay_histogram(_fact(spark, sf_dir))


@register("a30_booking_window_histogram", _hist_sql("lead_time_days", "lead_time_days IS NOT NULL", KP.WINDOW_BINS))
def a30_booking_window_histogram(spark, sf_dir):
    """Booking-window histogram (lead time 0 falls out, as in the reference)."""
    return KP.booking_window_histogram(_fact(spark, sf_dir))


@register("a31_traveler_mix", with_fixtures("""
da AS (SELECT destination_id, AVG(adr) AS a FROM daily_metrics GROUP BY destination_id),
hi AS (SELECT COALESCE(MAX(CASE WHEN a > (SELECT quantile_cont(a, 0.8) FROM da) THEN 1 ELSE 0 END), 0) AS high FROM da),
t AS (SELECT CASE WHEN SUM(bookings) > 0 THEN SUM(room_nights) / SUM(bookings) ELSE 3.0 END AS los,
  CAST(SUM(bookings) AS BIGINT) AS tb FROM daily_metrics),
m AS (SELECT tb, LEAST(55.0, 35 + los * 3) AS leisure, GREATEST(10.0, 30 - los * 2) AS business,
  CASE WHEN high = 1 THEN 15.0 ELSE 5.0 END AS luxury FROM t, hi),
m2 AS (SELECT *, GREATEST(5.0, 25 - business) AS family FROM m),
m3 AS (SELECT *, GREATEST(5.0, 100 - leisure - business - luxury - family) AS grp FROM m2),
m4 AS (SELECT *, leisure + business + family + grp + luxury AS rt FROM m3),
r AS (SELECT 1 AS ord, 'Leisure' AS category, leisure AS raw, tb, rt FROM m4
  UNION ALL SELECT 2, 'Business', business, tb, rt FROM m4 UNION ALL SELECT 3, 'Family', family, tb, rt FROM m4
  UNION ALL SELECT 4, 'Group', grp, tb, rt FROM m4 UNION ALL SELECT 5, 'Luxury', luxury, tb, rt FROM m4)""", """
SELECT ord, category, CAST(floor(tb * raw / rt) AS BIGINT) AS count, round_even(raw / rt * 100, 1) AS pct FROM r"""))
def a31_traveler_mix(spark, sf_dir):
    """Traveler-type mix heuristic."""
    return KP.traveler_mix(_fact(spark, sf_dir))


@register("a32_travel_type_flows", with_fixtures("""
f AS (SELECT travel_type, CAST(SUM(bookings) AS BIGINT) AS bookings, SUM(search_demand) AS search_demand,
  SUM(room_nights) AS room_nights, AVG(adr) AS avg_adr FROM daily_metrics WHERE travel_type IS NOT NULL GROUP BY 1)""", """
SELECT travel_type, bookings, round(search_demand, 6) AS search_demand, round(room_nights, 6) AS room_nights,
  round(avg_adr, 6) AS avg_adr, round_even(bookings / (SELECT SUM(bookings) FROM f) * 100, 1) AS share_pct FROM f"""))
def a32_travel_type_flows(spark, sf_dir):
    """Travel-type flows with booking share."""
    return KP.travel_type_flows(_fact(spark, sf_dir))


@register("a33_source_markets", with_fixtures("", """
SELECT DISTINCT source_market AS id FROM daily_metrics WHERE source_market IS NOT NULL ORDER BY id"""))
def a33_source_markets(spark, sf_dir):
    """Distinct source markets."""
    return KP.source_markets(_fact(spark, sf_dir))


IDX_SQL = TL_SQL + """,
fst AS (SELECT adr AS fa, search_demand AS fs, bookings AS fb FROM tl ORDER BY date LIMIT 1),
bs AS (SELECT CASE WHEN fa <> 0 THEN fa ELSE 1.0 END AS ba, CASE WHEN fs <> 0 THEN fs ELSE 1.0 END AS bsr,
  CASE WHEN fb <> 0 THEN fb ELSE 1.0 END AS bb FROM fst),
idx0 AS (SELECT date, round(COALESCE(adr, 0) / ba * 100, 1) AS hotel_index, round(COALESCE(search_demand, 0) / bsr * 100, 1) AS ota_index,
  round(COALESCE(bookings, 0) / bb * 100, 1) AS tech_index FROM tl, bs),
idx AS (SELECT *, (hotel_index + ota_index + tech_index) / 3 AS composite FROM idx0)"""


@register("a46_rebased_indices", with_fixtures(IDX_SQL, f"""
SELECT {cols('date', 'hotel_index:d', 'ota_index:d', 'tech_index:d', 'composite:d')} FROM idx"""))
def a46_rebased_indices(spark, sf_dir):
    """Rebased ADR / search / booking indices and composite."""
    return KP.rebased_indices(_fact(spark, sf_dir))


@register("a47_composite_prepost", with_fixtures(IDX_SQL + f""",
im AS (SELECT *, strftime(date, '%Y-%m') AS month FROM idx),
lst AS (SELECT * FROM idx ORDER BY date DESC LIMIT 1),
t AS (SELECT COALESCE(AVG(composite) FILTER (WHERE month < '1998-06'), 0.0) AS pre_index,
  COALESCE(AVG(composite) FILTER (WHERE month >= '1998-06'), 0.0) AS post_index,
  MIN(composite) FILTER (WHERE month >= '1998-06') AS post_trough, MIN(hotel_index) AS ht, MIN(ota_index) AS ot,
  MIN(tech_index) AS tt FROM im)""", """
SELECT round(pre_index, 6) AS pre_index, round(post_index, 6) AS post_index,
  round(CASE WHEN post_trough IS NULL THEN 0.0 WHEN post_trough > 0 THEN (l.composite - post_trough) / post_trough * 100 ELSE 0.0 END, 6) AS recovery_pct,
  round(l.hotel_index, 6) AS hotel_post, round(l.hotel_index - 100, 6) AS hotel_change,
  round(CASE WHEN ht > 0 THEN (l.hotel_index - ht) / ht * 100 ELSE 0.0 END, 6) AS hotel_recovery,
  round(l.ota_index, 6) AS ota_post, round(l.ota_index - 100, 6) AS ota_change,
  round(CASE WHEN ot > 0 THEN (l.ota_index - ot) / ot * 100 ELSE 0.0 END, 6) AS ota_recovery,
  round(l.tech_index, 6) AS tech_post, round(l.tech_index - 100, 6) AS tech_change,
  round(CASE WHEN tt > 0 THEN (l.tech_index - tt) / tt * 100 ELSE 0.0 END, 6) AS tech_recovery
FROM t, lst l"""))
def a47_composite_prepost(spark, sf_dir):
    """Composite index before / after, trough, recovery and sector table."""
    return KP.composite_prepost(_fact(spark, sf_dir), CRISIS_DATE)


@register("a48_volatility", with_fixtures(TL_SQL + """,
r AS (SELECT COALESCE(search_demand, 0) / bookings AS r FROM tl WHERE bookings > 0)""", """
SELECT round(CASE WHEN (SELECT COUNT(*) FROM r) >= 2 THEN (SELECT stddev_pop(r) FROM r) ELSE 0.0 END, 6) AS volatility_index,
  round((SELECT SUM(bookings) FROM daily_metrics) * (SELECT AVG(adr) FROM tl), 6) AS market_cap_proxy"""))
def a48_volatility(spark, sf_dir):
    """Volatility of the daily search/booking ratio and market-cap proxy."""
    return KP.volatility(_fact(spark, sf_dir))


@register("a51_booking_value", with_fixtures(TL_SQL + """,
t AS (SELECT CAST(SUM(bookings) AS BIGINT) AS b, COUNT(DISTINCT destination_id) AS n, SUM(search_demand) AS s FROM daily_metrics),
pa AS (SELECT AVG(adr) AS a FROM tl WHERE adr > 0)""", """
SELECT b AS total_bookings, n AS destinations_count, CASE WHEN n > 0 THEN round(b / n) ELSE 0.0 END AS avg_booking_volume,
  round(CASE WHEN n > 0 THEN b * a / n ELSE 0.0 END, 6) AS avg_booking_value,
  round(CASE WHEN s > 0 THEN b / s * 100 ELSE 0.0 END, 6) AS conversion_pct FROM t, pa"""))
def a51_booking_value(spark, sf_dir):
    """Bookings and booking value per destination."""
    return KP.booking_value_per_destination(_fact(spark, sf_dir))


@register("a52_revenue_scenarios", with_fixtures("""
g AS (SELECT destination_id, AVG(adr) AS adr, SUM(room_nights) AS rn, AVG(occupancy_rate) AS occ,
  CAST(SUM(bookings) AS BIGINT) AS b FROM daily_metrics GROUP BY destination_id)""", """
SELECT destination_id, round(adr * rn * occ, 6) AS hotel_revenue, round(1500.0::DOUBLE * b * 15.0 / 100, 6) AS tmc_revenue,
  round(b * (8.0 / 100 * adr + 3.0 + 1.5), 6) AS tech_revenue FROM g"""))
def a52_revenue_scenarios(spark, sf_dir):
    """Revenue calculators per destination with the UI default parameters."""
    return KP.revenue_scenarios(_fact(spark, sf_dir))


@register("x8_performance_indices", with_fixtures(HK_SQL + """,
m AS (SELECT AVG(occupancy_rate) AS o, AVG(adr) AS a, AVG(revpar) AS r FROM hk)""", """
SELECT destination_id, round(occupancy_rate / NULLIF(o, 0) * 100, 6) AS mpi, round(adr / NULLIF(a, 0) * 100, 6) AS ari,
  round(revpar / NULLIF(r, 0) * 100, 6) AS rgi FROM hk, m"""))
def x8_performance_indices(spark, sf_dir):
    """X8 (documented extra): MPI / ARI / RGI."""
    return KP.performance_indices(_fact(spark, sf_dir))


@register("x9_source_market_hhi", with_fixtures("""
bym AS (SELECT destination_id, source_market, SUM(bookings) AS b FROM daily_metrics GROUP BY 1, 2),
t AS (SELECT destination_id, SUM(b) AS t, SUM(b * b) AS b2, COUNT(*) AS markets FROM bym GROUP BY 1)""", """
SELECT destination_id, markets, round(CASE WHEN t > 0 THEN b2 / (t * t) END, 6) AS hhi FROM t"""))
def x9_source_market_hhi(spark, sf_dir):
    """X9 (documented extra): source-market Herfindahl index."""
    return KP.source_market_concentration(_fact(spark, sf_dir))
