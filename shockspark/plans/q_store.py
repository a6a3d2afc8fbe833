"""Catalogue entries: tables replaced in one step, the reservation log with
deduplication and a ledger of late rows (R1), summaries from daily sketches (A15, P1), the
store as a data source (K5, S7)."""

from __future__ import annotations

import posixpath

from pyspark.sql import functions as F

from shockspark.operators import quality as Q
from shockspark.operators import sketches as S
from shockspark.plans.catalog import register
from shockspark.plans.q_features import FEAT_SQL, engineered_fact
from shockspark.plans.q_io import FLIGHT_COLS, STORE_COLS
from shockspark.session import cut_lineage, scratch_path
from shockspark.sources import fixtures as fx
from shockspark.sources import sinks as K
from shockspark.sources import store_format
from shockspark.sources.fixture_sql import with_fixtures
from shockspark.sources.versioned import expire, read_table, replace_atomically
from shockspark.streaming.reservation_log import compact_log, read_reservation_fact, run_log


@register("k1_atomic_month_refresh", with_fixtures(FEAT_SQL, f"""
SELECT {STORE_COLS} FROM (SELECT * REPLACE (CASE WHEN year(date) = 1998 THEN bookings + 1000 ELSE bookings END AS bookings) FROM feat)"""))
def k1_atomic_month_refresh(spark, sf_dir):
    """K1: the fact as a versioned table, then the months of 1998 replaced in one step; the
    other months keep their files."""
    path, fact = scratch_path(spark, "fact-versions"), engineered_fact(spark, sf_dir)
    K.replace_daily_metrics(fact, path)
    renewed = fact.filter(F.col("date").between("1998-01-01", "1998-12-31"))
    K.replace_daily_metrics(renewed.withColumn("bookings", F.col("bookings") + 1000), path, months_only=True)
    return K.read_stored_metrics(spark, path)


@register("k3_atomic_replace_flights", with_fixtures("", f"""
SELECT {FLIGHT_COLS} FROM fact_flights WHERE origin_country <> destination_id"""))
def k3_atomic_replace_flights(spark, sf_dir):
    """K3: flights stored, replaced in one step by a part of the table itself, the first
    version removed."""
    path = scratch_path(spark, "flight-versions")
    replace_atomically(K.conform_flights(fx.fact_flights(spark, sf_dir)), path)
    replace_atomically(read_table(spark, path).filter("origin_country <> destination_id"), path)
    expire(spark, path, keep=1)
    return read_table(spark, path)


#: Days of the landings: the third lies before the second, the fourth is the first again.
LANDINGS = [("0001-01-01", "1996-07-01"), ("1998-03-01", "9999-01-01"), ("1996-07-01", "1998-03-01"), ("0001-01-01", "1996-07-01")]


@register("r1_reservation_log", with_fixtures("""
a AS (SELECT arrival_date AS date, destination_id, COUNT(*) FILTER (WHERE is_canceled = 0) AS bookings,
  COUNT(*) FILTER (WHERE is_canceled = 1) AS cancellations, COUNT(is_canceled) AS total_reservations, AVG(adr) AS adr,
  CAST(SUM(stays_in_weekend_nights + stays_in_week_nights) AS BIGINT) AS room_nights,
  COUNT(*) FILTER (WHERE arrival_date >= DATE '1996-07-01' AND arrival_date < DATE '1998-03-01') AS late_reservations
  FROM reservations GROUP BY 1, 2)""", """
SELECT date, destination_id, bookings, cancellations, total_reservations, round(adr, 6) AS adr, room_nights, late_reservations FROM a"""))
def r1_reservation_log(spark, sf_dir):
    """Reservations land in four waves, one of them out of order (its rows go to the
    ledger) and one twice (its rows count once); fact and ledger equal the batch daily
    aggregate (A1)."""
    landing, out = scratch_path(spark, "log-landing"), scratch_path(spark, "log-out")
    numbered = cut_lineage(fx.reservations(spark, sf_dir).withColumn("reservation_id", F.monotonically_increasing_id().cast("string")))
    day = F.col("arrival_date")
    for n, (start, end) in enumerate(LANDINGS):
        wave = numbered.filter((day >= F.lit(start).cast("date")) & (day < F.lit(end).cast("date")))
        wave.write.parquet(posixpath.join(landing, f"wave={n}"))
        run_log(spark, landing, out, posixpath.join(out, "_checkpoint"))
        if n == 1:
            compact_log(spark, out)
    return read_reservation_fact(spark, out, with_late=True)


def sketch_store(spark, sf_dir):
    """The fact's daily sketches, stored by month and read back."""
    path = scratch_path(spark, "sketches")
    S.store_sketches(S.daily_sketches(fx.daily_metrics(spark, sf_dir), sums=("bookings", "room_nights"), distinct=("destination_id",),
                                      spread=("adr",)), path)
    return read_table(spark, path)


@register("a15_sketch_summary", with_fixtures("", """
SELECT MIN(date) AS date_min, MAX(date) AS date_max, CAST(SUM(bookings) AS BIGINT) AS total_bookings,
  CAST(trunc(SUM(room_nights)) AS BIGINT) AS total_room_nights, COUNT(DISTINCT destination_id) AS destinations_count,
  COUNT(*) AS records_count FROM daily_metrics WHERE date BETWEEN DATE '1997-03-10' AND DATE '1998-11-20'"""))
def a15_sketch_summary(spark, sf_dir):
    """Summary of a date range merged from daily sketches; the fact is not read for it (the
    number of destinations is an estimate, exact for so few)."""
    return S.summary_of_range(sketch_store(spark, sf_dir), "1997-03-10", "1998-11-20")


@register("p1_sketch_bounds_error", with_fixtures("", """
SELECT COUNT(adr) AS n, true AS median_within, true AS p99_within FROM daily_metrics
WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"""))
def p1_sketch_bounds_error(spark, sf_dir):
    """The median and 99th percentile of five years merged from daily sketches, held against
    the rows: whether each is within 0.012 of its rank."""
    first, last = "1996-01-01", "2000-12-31"
    bounds = cut_lineage(S.clean_bounds(sketch_store(spark, sf_dir), first, last))
    adr = fx.daily_metrics(spark, sf_dir).filter(F.col("date").between(first, last) & F.col("adr").isNotNull())
    held = adr.select("adr", *[bounds.select(c).scalar().alias(c) for c in ("median", "p99")])

    def within(c, q):
        below, upto = F.count_if(F.col("adr") < F.col(c)), F.count_if(F.col("adr") <= F.col(c))
        n = F.count(F.lit(1))
        return ((below <= (q + 0.012) * n) & (upto >= (q - 0.012) * n)).alias(f"{c}_within")

    return held.agg(F.count(F.lit(1)).alias("n"), within("median", 0.5), within("p99", 0.99))


def stored(spark, df, name):
    """A copy of ``df`` through the library's data source."""
    store_format.register(spark)
    path = scratch_path(spark, name)
    df.write.format(store_format.NAME).mode("overwrite").save(path)
    return spark.read.format(store_format.NAME).load(path)


@register("k5_data_source_copy", with_fixtures("", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS source_rows, COUNT(*) AS target_rows, true AS match FROM {t}"
    for t in ("daily_metrics", "destinations", "crisis_events", "fact_flights", "fact_visas"))))
def k5_data_source_copy(spark, sf_dir):
    """K5: the five tables copied through the data source, and their rows reconciled."""
    sources = {"daily_metrics": fx.daily_metrics(spark, sf_dir), "destinations": fx.destinations(spark, sf_dir),
               "crisis_events": fx.crisis_events(spark), "fact_flights": fx.fact_flights(spark, sf_dir), "fact_visas": fx.fact_visas(spark, sf_dir)}
    return Q.reconcile_counts({name: (df, stored(spark, K.nullify_null_words(df), f"{name}-copy")) for name, df in sources.items()})


@register("s7_data_source_range", with_fixtures("", f"""
SELECT {FLIGHT_COLS} FROM fact_flights WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND origin_country <> destination_id"""))
def s7_data_source_range(spark, sf_dir):
    """A date range of flights from the data source; the dates reach its scan."""
    flights = stored(spark, K.conform_flights(fx.fact_flights(spark, sf_dir)), "flights-store")
    return flights.filter("date BETWEEN DATE'1998-01-01' AND DATE'1998-12-31' AND origin_country <> destination_id")
