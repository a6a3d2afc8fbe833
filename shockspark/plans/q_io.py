"""Catalogue entries: sources and sinks as round trips, and the quality checks
(SURVEY S1-S9, K1-K7, P1, P2, F6).

A round trip writes a frame derived from the test tables in the landing format to a
fresh folder inside the shared checkpoint folder, reads it back through the reader
under test and returns the result; the oracle computes the same rows in SQL from the
test tables.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import functions as F

from shockspark.operators import clean as CL
from shockspark.operators import features as FE
from shockspark.operators import quality as Q
from shockspark.plans.catalog import register
from shockspark.plans.q_features import FEAT_COLS, FEAT_SQL, engineered_fact
from shockspark.plans.sqlkit import cols
from shockspark.session import cut_lineage, scratch_path
from shockspark.sources import fixtures as fx
from shockspark.sources import loaders as L
from shockspark.sources import sinks as K
from shockspark.sources.fixture_sql import with_fixtures

CRISIS_START = "1998-06-01"


def hotel_csv(spark, sf_dir) -> str:
    """Reservations in the hotel-bookings CSV layout.  The month is written as a name
    on even days and as a number on odd days (both forms must parse); adr is left
    empty for reservations with lead time 44 (the cleaner fills them)."""
    r = fx.reservations(spark, sf_dir)
    d = F.col("arrival_date")
    month = F.when(F.dayofmonth(d) % 2 == 0, F.date_format(d, "MMMM")).otherwise(F.month(d).cast("string"))
    out = r.select(
        F.col("destination_id").alias("hotel"), F.col("is_canceled").cast("string").alias("is_canceled"),
        F.col("lead_time_days").cast("string").alias("lead_time"),
        F.year(d).cast("string").alias("arrival_date_year"), month.alias("arrival_date_month"),
        F.dayofmonth(d).cast("string").alias("arrival_date_day_of_month"),
        F.col("stays_in_weekend_nights").cast("string"), F.col("stays_in_week_nights").cast("string"),
        F.lit("2").alias("adults"), F.lit("0").alias("children"), F.col("source_market").alias("country"),
        F.when(F.col("lead_time_days") == 44, F.lit(None)).otherwise(F.col("adr")).cast("string").alias("adr"),
        F.when(F.col("is_canceled") == 1, "Canceled").otherwise("Check-Out").alias("reservation_status"))
    path = scratch_path(spark, "hotel-csv")
    out.write.option("header", "true").csv(path)
    return path


HOTEL_SQL = """
hb AS (SELECT arrival_date, destination_id AS hotel, is_canceled, lead_time_days AS lead_time,
  stays_in_weekend_nights, stays_in_week_nights, source_market AS country,
  CASE WHEN lead_time_days = 44 THEN NULL ELSE adr END AS adr FROM reservations)"""


@register("s1_load_hotel_bookings", with_fixtures(HOTEL_SQL, f"""
SELECT {cols('arrival_date', 'hotel', 'is_canceled', 'lead_time', 'stays_in_weekend_nights',
             'stays_in_week_nights', 'country', 'adr:d')} FROM hb"""))
def s1_load_hotel_bookings(spark, sf_dir):
    """Hotel-bookings CSV round trip (month as name and as number)."""
    b = L.load_hotel_bookings(spark, hotel_csv(spark, sf_dir))
    return b.select("arrival_date", "hotel", "is_canceled", "lead_time", "stays_in_weekend_nights",
                    "stays_in_week_nights", "country", "adr")


@register("p1_clean_hotel_bookings", with_fixtures(HOTEL_SQL + """,
years AS (SELECT * FROM hb WHERE year(arrival_date) BETWEEN 1996 AND 2000),
filled AS (SELECT * REPLACE (coalesce(adr, (SELECT median(adr) FROM years)) AS adr) FROM years),
cl AS (SELECT * REPLACE (least(greatest(adr, 0.0), (SELECT quantile_cont(adr, 0.99) FROM filled)) AS adr) FROM filled)""", f"""
SELECT {cols('arrival_date', 'hotel', 'is_canceled', 'lead_time', 'stays_in_weekend_nights',
             'stays_in_week_nights', 'country', 'adr:d')} FROM cl"""))
def p1_clean_hotel_bookings(spark, sf_dir):
    """Cleaning with exact median fill and p99 clip.  The test data lies in
    1995-2001, so the year window is [1996, 2000] instead of the default [2015, 2030];
    rows outside it take no part in the median."""
    # The exact median / p99 read their input several times: parse the CSV once.
    b = cut_lineage(L.load_hotel_bookings(spark, hotel_csv(spark, sf_dir)))
    c = CL.clean_hotel_bookings(b, 1996, 2000)
    return c.select("arrival_date", "hotel", "is_canceled", "lead_time", "stays_in_weekend_nights",
                    "stays_in_week_nights", "country", "adr")


SEARCH_SQL = """
srch AS (SELECT date, destination_id, SUM(search_demand) AS search_demand FROM daily_metrics GROUP BY date, destination_id)"""


@register("p2_search_demand_roundtrip", with_fixtures(SEARCH_SQL, """
SELECT date, destination_id, round(search_demand, 6) AS search_demand, round(search_demand, 6) AS searches FROM srch"""))
def p2_search_demand_roundtrip(spark, sf_dir):
    """S2 + P2: searches CSV (column ``searches``) read back, coerced and cleaned."""
    s = fx.daily_metrics(spark, sf_dir).groupBy("date", "destination_id").agg(
        F.sum("search_demand").alias("searches"))
    path = scratch_path(spark, "search-csv")
    s.write.option("header", "true").csv(path)
    return CL.clean_search_demand(L.load_search_demand(spark, path))


DEST_SQL_COLS = "SELECT destination_id, destination_name, region FROM destinations"


@register("s4_load_destinations", with_fixtures("", DEST_SQL_COLS))
def s4_load_destinations(spark, sf_dir):
    """Destinations CSV round trip."""
    path = scratch_path(spark, "dest-csv")
    fx.destinations(spark, sf_dir).write.option("header", "true").csv(path)
    return L.load_destinations(spark, path)


@register("s4_destinations_fallback", with_fixtures("", """
SELECT DISTINCT destination_id, destination_id AS destination_name, CAST(NULL AS VARCHAR) AS region FROM daily_metrics"""))
def s4_destinations_fallback(spark, sf_dir):
    """No destinations file -> distinct destinations of the fact."""
    return L.load_destinations(spark, None, fx.daily_metrics(spark, sf_dir))


DEMAND_SQL = """
dem AS (SELECT date, destination_id AS destination, source_market, bookings, CAST(search_demand AS INTEGER) AS searches,
  cancellations, adr, room_nights, lead_time_days, occupancy_rate, avg_length_of_stay, travel_type FROM daily_metrics)"""


def demand_csv(spark, sf_dir) -> str:
    m = fx.daily_metrics(spark, sf_dir)
    out = m.select("date", F.col("destination_id").alias("destination"), "source_market", "bookings",
                   F.col("search_demand").cast("int").alias("searches"), "cancellations", "adr", "room_nights",
                   "lead_time_days", "occupancy_rate", "avg_length_of_stay", "travel_type")
    path = scratch_path(spark, "demand-csv")
    out.write.option("header", "true").csv(path)
    return path


@register("s5_load_demand_csv", with_fixtures(DEMAND_SQL, f"""
SELECT {cols('date', 'destination', 'source_market', 'bookings', 'searches', 'cancellations', 'adr:d', 'room_nights:d',
             'lead_time_days', 'occupancy_rate:d', 'avg_length_of_stay:d', 'travel_type')} FROM dem"""))
def s5_load_demand_csv(spark, sf_dir):
    """Demand CSV round trip."""
    return L.load_demand_csv(spark, demand_csv(spark, sf_dir))


@register("f6_destination_baseline_features", with_fixtures(DEMAND_SQL + f""",
d2 AS (SELECT *, destination AS destination_id, bookings + cancellations AS total_reservations,
  CAST(searches AS DOUBLE) AS search_demand FROM dem),
bl AS (SELECT destination_id, AVG(bookings) AS bb0, AVG(adr) AS ba0 FROM d2
  WHERE date BETWEEN DATE '1998-05-02' AND DATE '1998-05-31' GROUP BY destination_id),
g AS (SELECT AVG(bookings) AS mb, AVG(adr) AS ma FROM d2),
j AS (SELECT d2.*, CASE WHEN COALESCE(bl.bb0, g.mb) = 0 THEN 1.0 ELSE COALESCE(bl.bb0, g.mb) END AS bb,
  COALESCE(bl.ba0, g.ma) AS ba, GREATEST(date_diff('day', DATE '{CRISIS_START}', date), 0) AS ds
  FROM d2 LEFT JOIN bl ON d2.destination_id = bl.destination_id, g)""", f"""
SELECT {cols('date', 'destination_id', 'bookings', 'cancellations', 'total_reservations', 'search_demand:d', 'adr:d',
             'room_nights:d')},
  round(CAST(bookings AS DOUBLE), 6) AS bookings_per_day,
  round(CASE WHEN total_reservations > 0 THEN cancellations / total_reservations ELSE 0.0 END, 6) AS cancellation_rate,
  round(CASE WHEN bookings > 0 THEN search_demand / bookings END, 6) AS search_to_booking_ratio,
  round((adr - ba) / NULLIF(ba, 0) * 100, 6) AS adr_change,
  round((bookings - bb) / NULLIF(bb, 0) * 100, 6) AS demand_change_percent,
  round(bookings / NULLIF(bb, 0) * 100, 6) AS normalized_demand_index,
  CAST(ds AS INTEGER) AS days_since_crisis,
  CASE WHEN ds <= 0 THEN 'pre_crisis' WHEN ds <= 14 THEN 'immediate' WHEN ds <= 90 THEN 'short_term' ELSE 'recovery' END AS crisis_phase,
  1 AS crisis_id, lead_time_days, round(occupancy_rate, 6) AS occupancy_rate, source_market,
  round(avg_length_of_stay, 6) AS avg_length_of_stay, travel_type
FROM j"""))
def f6_destination_baseline_features(spark, sf_dir):
    """F6 + J3: demand CSV -> fact with per-destination baselines (day 0 pre_crisis)."""
    dem = L.load_demand_csv(spark, demand_csv(spark, sf_dir))
    return FE.demand_to_daily_metrics(dem, CRISIS_START, 30, 1)


def _csv_roundtrip(spark, df, name, reader):
    path = scratch_path(spark, name)
    df.write.option("header", "true").csv(path)
    return reader(spark, path)


FLIGHT_COLS = cols("date", "origin_country", "destination_id", "route", "flights_count", "seat_capacity:d",
                   "load_factor:d", "avg_airfare:d", "airline")
VISA_COLS = cols("date", "origin_country", "destination_id", "visa_applications", "visa_issued", "visa_rejected",
                 "visa_type", "processing_days:d")


@register("s6_load_flights_csv", with_fixtures("", f"SELECT {FLIGHT_COLS} FROM fact_flights"))
def s6_load_flights_csv(spark, sf_dir):
    """Flights CSV round trip."""
    return _csv_roundtrip(spark, fx.fact_flights(spark, sf_dir), "flights-csv", L.load_flights_csv)


@register("s6_load_visas_csv", with_fixtures("", f"SELECT {VISA_COLS} FROM fact_visas"))
def s6_load_visas_csv(spark, sf_dir):
    """Visas CSV round trip."""
    return _csv_roundtrip(spark, fx.fact_visas(spark, sf_dir), "visas-csv", L.load_visas_csv)


def write_store(spark, sf_dir) -> str:
    """K1 + K2: the store (engineered fact by month, crisis and destination tables)."""
    root = scratch_path(spark, "store")
    K.write_daily_metrics(engineered_fact(spark, sf_dir), posixpath.join(root, "daily_metrics"))
    K.replace_table(K.conform_crisis_events(fx.crisis_events(spark)), posixpath.join(root, "crisis_events"))
    K.replace_table(K.conform_destinations(fx.destinations(spark, sf_dir)), posixpath.join(root, "destinations"))
    return root


STORE_COLS = cols("date", "destination_id", "crisis_id", "bookings", "cancellations", "total_reservations",
                  "search_demand:d", "adr:d", "room_nights:d", "bookings_per_day:d", "cancellation_rate:d",
                  "search_to_booking_ratio:d", "adr_change:d", "demand_change_percent:d",
                  "normalized_demand_index:d", "crisis_phase", "days_since_crisis", "source_market",
                  "avg_length_of_stay:d", "travel_type", "lead_time_days", "occupancy_rate:d")


@register("k1_write_read_fact", with_fixtures(FEAT_SQL, f"SELECT {STORE_COLS} FROM feat"))
def k1_write_read_fact(spark, sf_dir):
    """K1: engineered fact written partitioned by month and read back."""
    root = write_store(spark, sf_dir)
    return K.read_daily_metrics(spark, posixpath.join(root, "daily_metrics"))


@register("s7_load_db_range", with_fixtures(FEAT_SQL, f"""
SELECT {STORE_COLS} FROM feat WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"""))
def s7_load_db_range(spark, sf_dir):
    """Load the store with a pushed-down date range."""
    root = write_store(spark, sf_dir)
    return L.load_db(spark, root, "1998-01-01", "1998-12-31")["daily_metrics"].drop("month")


@register("k2_destinations_without_region", with_fixtures("", """
SELECT destination_id, destination_name, CAST(NULL AS VARCHAR) AS region FROM destinations"""))
def k2_destinations_without_region(spark, sf_dir):
    """K2: destinations replaced from a frame without ``region`` -> NULL region."""
    path = scratch_path(spark, "dest-k2")
    K.replace_table(K.conform_destinations(fx.destinations(spark, sf_dir).drop("region")), path)
    return spark.read.parquet(path)


@register("k3_replace_flights", with_fixtures("", f"SELECT {FLIGHT_COLS} FROM fact_flights"))
def k3_replace_flights(spark, sf_dir):
    """K3: flights fact replaced in the store and read back."""
    path = scratch_path(spark, "flights-k3")
    K.replace_table(K.conform_flights(fx.fact_flights(spark, sf_dir)), path)
    return spark.read.parquet(path)


@register("k3_replace_visas", with_fixtures("", f"SELECT {VISA_COLS} FROM fact_visas"))
def k3_replace_visas(spark, sf_dir):
    """K3: visas fact replaced in the store and read back."""
    path = scratch_path(spark, "visas-k3")
    K.replace_table(K.conform_visas(fx.fact_visas(spark, sf_dir)), path)
    return spark.read.parquet(path)


@register("k5_copy_and_reconcile", with_fixtures("", """
SELECT 'daily_metrics' AS table_name, COUNT(*) AS source_rows, COUNT(*) AS target_rows, true AS match FROM daily_metrics
UNION ALL SELECT 'destinations', COUNT(*), COUNT(*), true FROM destinations
UNION ALL SELECT 'crisis_events', COUNT(*), COUNT(*), true FROM crisis_events
UNION ALL SELECT 'fact_flights', COUNT(*), COUNT(*), true FROM fact_flights
UNION ALL SELECT 'fact_visas', COUNT(*), COUNT(*), true FROM fact_visas"""))
def k5_copy_and_reconcile(spark, sf_dir):
    """K5: copy the five tables to a second store (null words -> NULL) and reconcile
    the row counts."""
    root = scratch_path(spark, "copy")
    src = {"daily_metrics": fx.daily_metrics(spark, sf_dir), "destinations": fx.destinations(spark, sf_dir),
           "crisis_events": fx.crisis_events(spark), "fact_flights": fx.fact_flights(spark, sf_dir),
           "fact_visas": fx.fact_visas(spark, sf_dir)}
    pairs = {}
    for name, df in src.items():
        p = posixpath.join(root, name)
        K.replace_table(K.nullify_null_words(df), p)
        pairs[name] = (df, spark.read.parquet(p))
    return Q.reconcile_counts(pairs)


NULL_WORDS = {"REGION_0": " NaN ", "REGION_1": "None", "REGION_2": "nat", "REGION_3": "  "}


@register("k5_null_words", with_fixtures("", f"""
SELECT destination_id, destination_name, IF(region IN ({", ".join(f"'{r}'" for r in NULL_WORDS)}), NULL, region) AS region FROM destinations"""))
def k5_null_words(spark, sf_dir):
    """K5: a table whose regions are partly spelled-out missing values, copied and read back."""
    words = F.create_map(*[F.lit(x) for pair in NULL_WORDS.items() for x in pair])
    d = fx.destinations(spark, sf_dir)
    spelled = d.withColumn("region", F.coalesce(F.try_element_at(words, F.col("region")), F.col("region")))
    path = scratch_path(spark, "null-words")
    K.replace_table(K.nullify_null_words(spelled), path)
    return spark.read.parquet(path).select("destination_id", "destination_name", "region")


@register("k2_crisis_events", with_fixtures("", """
SELECT crisis_id, crisis_name, crisis_start_date, CAST(NULL AS DATE) AS crisis_end_date, CAST(NULL AS VARCHAR[]) AS affected_regions
FROM crisis_events"""))
def k2_crisis_events(spark, sf_dir):
    """K2: crises replaced from a frame without end dates and regions -> NULL."""
    path = scratch_path(spark, "crises-k2")
    K.replace_table(K.conform_crisis_events(fx.crisis_events(spark).drop("crisis_end_date", "affected_regions")), path)
    return spark.read.parquet(path)


@register("k6_json_special_numbers", with_fixtures("", """
SELECT '{"destination_id":"' || destination_id || '","ratio":' || CASE WHEN bookings = 0 OR cancellations = 0 THEN 'null'
  ELSE CAST(bookings AS VARCHAR) || '.0' END || '}' AS json FROM daily_metrics"""))
def k6_json_special_numbers(spark, sf_dir):
    """K6: NaN and infinite doubles become null."""
    b, c = F.col("bookings"), F.col("cancellations")
    special = F.when(b == 0, F.lit(float("nan"))).when((c == 0) & (b % 2 == 0), F.lit(float("inf"))).when(c == 0, F.lit(float("-inf")))
    m = fx.daily_metrics(spark, sf_dir).select("destination_id", special.otherwise(b.cast("double")).alias("ratio"))
    return K.to_json_records(m)


@register("k6_json_records", with_fixtures("", """
SELECT to_json(struct_pack(date := strftime(date, '%Y-%m-%d'), destination_id := destination_id,
  source_market := source_market, bookings := bookings, cancellations := cancellations,
  lead_time_days := lead_time_days, travel_type := travel_type))::VARCHAR AS json FROM daily_metrics"""))
def k6_json_records(spark, sf_dir):
    """K6: fact rows as JSON records (dates yyyy-MM-dd)."""
    m = fx.daily_metrics(spark, sf_dir).select("date", "destination_id", "source_market", "bookings",
                                               "cancellations", "lead_time_days", "travel_type")
    return K.to_json_records(m)


@register("k7_key_and_null_checks", with_fixtures(FEAT_SQL + """,
dk AS (SELECT date, destination_id, source_market, crisis_id, COUNT(*) AS n FROM feat
  GROUP BY date, destination_id, source_market, crisis_id)""", """
SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE date IS NULL) AS null_date,
  COUNT(*) FILTER (WHERE destination_id IS NULL) AS null_destination_id,
  COUNT(*) FILTER (WHERE bookings_per_day IS NULL) AS null_bookings_per_day,
  COUNT(*) FILTER (WHERE cancellation_rate IS NULL) AS null_cancellation_rate,
  (SELECT COUNT(*) FROM dk) AS distinct_keys, (SELECT COUNT(*) FILTER (WHERE n > 1) FROM dk) AS duplicate_keys
FROM feat"""))
def k7_key_and_null_checks(spark, sf_dir):
    """K7: key uniqueness and NOT NULL checks of the engineered fact."""
    return Q.key_and_null_checks(engineered_fact(spark, sf_dir))


# Nation and year parity whose values the indicator source does not know.
UNKNOWN_NATION, UNKNOWN_PARITY = "NATION_3", 0


def indicator_pages(spark, sf_dir, per_page: int = 50) -> str:
    """Yearly arrivals per origin nation (non-canceled reservations) as indicator JSON
    pages of about ``per_page`` items, one page document per line; the even years of one
    nation have a null value (the reader drops them)."""
    r = fx.reservations(spark, sf_dir)
    yearly = cut_lineage(r.groupBy(F.col("source_market").alias("cid"), F.year("arrival_date").alias("year")).agg(
        F.count_if(F.col("is_canceled") == 0).alias("arrivals")))
    known = (F.col("cid") != UNKNOWN_NATION) | (F.col("year") % 2 != UNKNOWN_PARITY)
    item = F.struct(F.struct(F.col("cid").alias("id"), F.initcap(F.regexp_replace("cid", "_", " ")).alias("value"))
                    .alias("country"), F.col("year").cast("string").alias("date"),
                    F.when(known, F.col("arrivals").cast("double")).alias("value"))
    n_pages = yearly.agg(F.ceil(F.count(F.lit(1)) / per_page)).scalar()
    pages = yearly.withColumn("page", F.pmod(F.hash("cid", "year"), n_pages))
    docs = pages.groupBy("page").agg(F.collect_list(item).alias("items")).select(
        F.concat(F.lit("["), F.to_json(F.struct(F.col("page").alias("page"), F.lit(per_page).alias("per_page"))),
                 F.lit(","), F.to_json("items"), F.lit("]")).alias("value"))
    path = scratch_path(spark, "indicator-json")
    docs.write.text(path)
    return path


@register("s9_indicator_json", with_fixtures("", f"""
SELECT source_market AS country_code, 'Nation ' || substr(source_market, 8) AS country_name,
  CAST(year(arrival_date) AS INTEGER) AS year, CAST(COUNT(*) FILTER (WHERE is_canceled = 0) AS DOUBLE) AS arrivals
FROM reservations WHERE source_market <> '{UNKNOWN_NATION}' OR year(arrival_date) % 2 <> {UNKNOWN_PARITY}
GROUP BY source_market, year(arrival_date)"""))
def s9_indicator_json(spark, sf_dir):
    """Indicator JSON pages -> (country_code, country_name, year, arrivals)."""
    return L.load_indicator_json(spark, indicator_pages(spark, sf_dir))
