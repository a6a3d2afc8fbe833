"""Catalogue entry: incremental daily fact."""

from __future__ import annotations

import posixpath

from pyspark.sql import functions as F

from shockspark.plans.catalog import register
from shockspark.session import scratch_path
from shockspark.sources import fixtures as fx
from shockspark.sources.fixture_sql import with_fixtures
from shockspark.streaming.incremental_fact import RESERVATION_SCHEMA, compact, read_incremental_fact, run_incremental


WAVES = ("1996-07-01", "1998-03-01", "9999-01-01")


def land_wave(spark, sf_dir, landing: str, start: str, end: str) -> None:
    """Reservations of some days land as Parquet files in month folders (a month that is
    large for one task in several files)."""
    r = fx.reservations(spark, sf_dir).select(*[f.name for f in RESERVATION_SCHEMA.fields])
    d = F.col("arrival_date")
    r = r.filter((d >= F.lit(start).cast("date")) & (d < F.lit(end).cast("date"))).withColumn("month", F.date_format(d, "yyyy-MM"))
    r.hint("rebalance", "month").write.mode("append").partitionBy("month").parquet(landing)


@register("r1_incremental_daily_fact", with_fixtures("""
a AS (SELECT arrival_date AS date, destination_id, COUNT(*) FILTER (WHERE is_canceled = 0) AS bookings,
  COUNT(*) FILTER (WHERE is_canceled = 1) AS cancellations, COUNT(is_canceled) AS total_reservations, AVG(adr) AS adr,
  CAST(SUM(stays_in_weekend_nights + stays_in_week_nights) AS BIGINT) AS room_nights
  FROM reservations GROUP BY 1, 2)""", """
SELECT date, destination_id, bookings, cancellations, total_reservations, round(adr, 6) AS adr, room_nights FROM a"""))
def r1_incremental_daily_fact(spark, sf_dir):
    """Streaming daily fact over reservations that land in three waves, each one taken
    up by a restarted query (availableNow), with a compaction between them; read back as
    the newest version per key; equals the batch daily aggregate (A1)."""
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "stream-out")
    for start, end in zip(("0001-01-01", *WAVES), WAVES):
        land_wave(spark, sf_dir, landing, start, end)
        run_incremental(spark, landing, out, posixpath.join(out, "_checkpoint"))
        if end == WAVES[1]:
            compact(spark, out)
    return read_incremental_fact(spark, out)
