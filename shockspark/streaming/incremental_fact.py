"""Incremental daily fact with Structured Streaming.

Reservations land as Parquet files in a folder.  A streaming query aggregates them
into the daily fact per (day, destination) with a watermark on the arrival date:

* ``readStream`` (files, explicit schema) -> ``withWatermark`` -> aggregate per
  (event day, destination) (state bounded by the watermark);
* ``outputMode('update')``: every micro-batch emits the keys it changed with their
  full current value;
* ``foreachBatch`` writes those rows to ``<out>/updates/batch_id=<id>`` with
  ``overwrite`` of that one partition, so a batch replayed after a failure rewrites
  the same files (idempotent, no duplicates);
* readers take the newest version of each key (``max_by`` over ``batch_id``), one
  ``groupBy`` - the log-structured upsert a table format would do with MERGE - from
  the last snapshot that ``compact`` wrote and the batches after it.

Rows older than the watermark when they arrive are dropped by the engine.  The
checkpoint location keeps offsets and state, so a restarted query continues where it
stopped.
"""

from __future__ import annotations

import posixpath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESERVATION_SCHEMA = T.StructType([
    T.StructField("arrival_date", T.DateType()), T.StructField("destination_id", T.StringType()),
    T.StructField("source_market", T.StringType()), T.StructField("is_canceled", T.IntegerType()),
    T.StructField("stays_in_weekend_nights", T.IntegerType()), T.StructField("stays_in_week_nights", T.IntegerType()),
    T.StructField("adr", T.DoubleType()),
])

KEY = ["date", "destination_id"]


def daily_fact_stream(spark: SparkSession, landing: str, watermark: str = "3 days",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """The streaming aggregate: (date, destination_id) -> bookings, cancellations,
    total reservations, mean adr, room nights."""
    r = spark.readStream.schema(RESERVATION_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    src = r.parquet(landing).withColumn("event_ts", F.col("arrival_date").cast("timestamp"))
    nights = F.coalesce(F.col("stays_in_weekend_nights"), F.lit(0)) + F.coalesce(F.col("stays_in_week_nights"), F.lit(0))
    # Group on the event-time column itself (midnight of the arrival day) and the day:
    # state is evicted once the watermark passes the day, and the day key does not
    # depend on the session time zone (a 1-day window() is aligned in epoch time).
    agg = (src.withWatermark("event_ts", watermark)
           .groupBy("event_ts", F.col("arrival_date").alias("date"), "destination_id")
           .agg(F.count_if(F.col("is_canceled") == 0).alias("bookings"),
                F.count_if(F.col("is_canceled") == 1).alias("cancellations"),
                F.count("is_canceled").alias("total_reservations"),
                F.avg("adr").alias("adr"), F.sum(nights).alias("room_nights")))
    return agg.select("date", "destination_id", "bookings",
                      "cancellations", "total_reservations", "adr", "room_nights")


def _writer(out: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(posixpath.join(out, "updates")))
    return write


def run_incremental(spark: SparkSession, landing: str, out: str, checkpoint: str,
                    watermark: str = "3 days", max_files_per_trigger: int | None = None) -> None:
    """Process everything that has landed (``availableNow``) and stop."""
    q = (daily_fact_stream(spark, landing, watermark, max_files_per_trigger).writeStream
         .outputMode("update").foreachBatch(_writer(out))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def _snapshot(spark: SparkSession, out: str) -> tuple[int, DataFrame | None]:
    """The last batch that a snapshot covers, and that snapshot (-1 and None without one)."""
    try:
        snapshots = spark.read.parquet(posixpath.join(out, "snapshots"))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return -1, None
        raise
    upto = snapshots.agg(F.max("upto")).first()[0]
    return upto, snapshots.filter(F.col("upto") == upto).drop("upto")


def read_incremental_fact(spark: SparkSession, out: str) -> DataFrame:
    """Current fact: the newest version of every (date, destination) key, from the last
    snapshot and the batches after it."""
    upto, snapshot = _snapshot(spark, out)
    log = spark.read.parquet(posixpath.join(out, "updates")).filter(F.col("batch_id") > upto)
    if snapshot is not None:
        log = log.unionByName(snapshot.withColumn("batch_id", F.lit(upto)))
    values = [c for c in log.columns if c not in KEY + ["batch_id"]]
    latest = log.groupBy(*KEY).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return latest.select(*KEY, *[F.col(f"v.{c}").alias(c) for c in values])


def compact(spark: SparkSession, out: str) -> None:
    """Write the current fact as a snapshot, so that readers no longer fold the batches it
    covers; these, and older snapshots, may then be removed."""
    upto, snapshot = _snapshot(spark, out)
    newest = spark.read.parquet(posixpath.join(out, "updates")).agg(F.max("batch_id")).first()[0]
    if newest is not None and newest > upto:
        (read_incremental_fact(spark, out).withColumn("upto", F.lit(newest)).write.mode("append").partitionBy("upto")
         .parquet(posixpath.join(out, "snapshots")))
