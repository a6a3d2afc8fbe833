"""Daily fact of landed reservations, each counted once, none lost.

``incremental_fact`` leaves two things to the engine: a reservation that lands twice counts
twice, and a row behind the watermark vanishes.  Here

* reservations have an id; a batch keeps one row of each id that no batch before it wrote to
  ``<out>/ids``, and adds its own ids with the time they landed (the time of the micro-batch,
  which the offset log keeps, so a replay sees the same).  They are known for ``remember`` at
  least, twice that at most.  One shuffle by id serves both steps, and ids lie in columns on
  the shared storage, not as rows of a state store in the executors' heaps;
* lateness is by the day of arrival: rows more than ``lateness`` days before the newest day of
  all earlier batches go to ``<out>/ledger`` in the same batch, with the reason, and so do rows
  without a day or a destination.  The others become sums per (day, destination) in
  ``<out>/sums``.  Fact and ledger together hold every reservation;
* sums of batches add up, so only ids are remembered and no day is kept open;
* every batch overwrites the partitions of its own batch id: a batch replayed after a
  failure leaves the same files.  ``compact_log`` folds the sums so far into a versioned
  table, replaced in one step.

Defined cases: a null id is never a repetition; of rows with one id any one of the batch in
which the id first lands counts; one day far ahead makes all that follow late, but loses
none; without any batch the fact is empty.
"""

from __future__ import annotations

import datetime
import posixpath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shockspark.sources.versioned import expire, read_table, replace_atomically, versions
from shockspark.streaming.incremental_fact import KEY, RESERVATION_SCHEMA

LANDED = T.StructType([T.StructField("reservation_id", T.StringType()), *RESERVATION_SCHEMA.fields])
ADDED = ["bookings", "cancellations", "total_reservations", "adr_sum", "adr_count", "room_nights"]
SUMS = T.StructType([T.StructField("date", T.DateType()), T.StructField("destination_id", T.StringType()),
                     *[T.StructField(c, T.DoubleType() if c == "adr_sum" else T.LongType()) for c in ADDED],
                     T.StructField("batch_id", T.LongType())])
LEDGER = T.StructType([*LANDED.fields, T.StructField("reason", T.StringType()), T.StructField("batch_id", T.LongType())])
IDS = T.StructType([T.StructField("reservation_id", T.StringType()), T.StructField("landed_at", T.TimestampType()), T.StructField("batch_id", T.LongType())])
MARKS = T.StructType([T.StructField("newest", T.DateType()), T.StructField("batch_id", T.LongType())])


def landed_reservations(spark: SparkSession, landing: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The stream of landed reservations with the time of their micro-batch."""
    r = spark.readStream.schema(LANDED)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(landing).select(*LANDED.names, F.current_timestamp().alias("landed_at"))


def daily_sums(r: DataFrame) -> DataFrame:
    """Sums per (day, destination) that add up over batches."""
    nights = F.coalesce(F.col("stays_in_weekend_nights"), F.lit(0)) + F.coalesce(F.col("stays_in_week_nights"), F.lit(0))
    return r.groupBy(F.col("arrival_date").alias("date"), "destination_id").agg(
        F.count_if(F.col("is_canceled") == 0).alias("bookings"), F.count_if(F.col("is_canceled") == 1).alias("cancellations"),
        F.count("is_canceled").alias("total_reservations"), F.sum("adr").alias("adr_sum"), F.count("adr").alias("adr_count"),
        F.sum(nights.cast("long")).alias("room_nights"))


def _read(spark: SparkSession, out: str, name: str, schema: T.StructType) -> DataFrame:
    """One of the folders by batch (empty before its first batch)."""
    try:
        return spark.read.schema(schema).parquet(posixpath.join(out, name))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def _write(df: DataFrame, out: str, name: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(posixpath.join(out, name, f"batch_id={batch_id}"))


def _new_reservations(batch: DataFrame, out: str, batch_id: int, remember: str) -> DataFrame:
    """One row of each id that is not known from an earlier batch, and all rows without id."""
    until = (F.col("landed_at") + F.expr(f"2 * INTERVAL '{remember}'")).alias("until")
    known = _read(batch.sparkSession, out, "ids", IDS).filter(F.col("batch_id") < batch_id).select(F.col("reservation_id").alias("known_id"), until)
    named = batch.filter("reservation_id IS NOT NULL").dropDuplicates(["reservation_id"])
    again = (F.col("reservation_id") == F.col("known_id")) & (F.col("landed_at") < F.col("until"))
    return named.join(known.hint("merge"), again, "left_anti").unionByName(batch.filter("reservation_id IS NULL"))


def _writer(out: str, lateness: int, remember: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = _read(spark, out, "marks", MARKS).filter(F.col("batch_id") < batch_id).agg(F.max_by("newest", "batch_id")).first()[0]
        day = F.col("arrival_date")
        late = F.lit(False) if newest is None else day < F.lit(newest - datetime.timedelta(days=lateness))
        reason = F.when(day.isNull() | F.col("destination_id").isNull(), "no key").when(late, "late")
        judged = _new_reservations(batch, out, batch_id, remember).withColumn("reason", reason).persist()  # in memory and on disk, for all writes
        try:
            _write(judged.filter("reservation_id IS NOT NULL").select("reservation_id", "landed_at"), out, "ids", batch_id)
            _write(daily_sums(judged.filter("reason IS NULL")), out, "sums", batch_id)
            _write(judged.filter("reason IS NOT NULL").drop("landed_at"), out, "ledger", batch_id)
        finally:
            judged.unpersist()
        own = _read(spark, out, "sums", SUMS).filter(F.col("batch_id") == batch_id).agg(F.max("date").alias("newest"))
        _write(own.select(F.greatest("newest", F.lit(newest).cast("date")).alias("newest")), out, "marks", batch_id)
    return write


def run_log(spark: SparkSession, landing: str, out: str, checkpoint: str, remember: str = "30 days", lateness: int = 30,
            max_files_per_trigger: int | None = None) -> None:
    """Take up everything that has landed (``availableNow``) and stop.  ``remember``: how long
    ids are known after they landed; ``lateness``: days behind the newest day that still
    count as on time."""
    q = (landed_reservations(spark, landing, max_files_per_trigger).writeStream.outputMode("append")
         .foreachBatch(_writer(out, lateness, remember)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def _folded(spark: SparkSession, out: str) -> DataFrame:
    """Sums of on-time reservations: of the last compaction, and of the batches after it."""
    path, sums = posixpath.join(out, "compacted"), _read(spark, out, "sums", SUMS)
    if versions(spark, path):
        compacted = read_table(spark, path)
        upto = compacted.agg(F.max("batch_id")).first()[0]
        if upto is not None:
            sums = sums.filter(F.col("batch_id") > upto).unionByName(compacted)
    return sums


def compact_log(spark: SparkSession, out: str) -> None:
    """Fold the sums of all batches so far into one table; the folders of the batches it covers
    may then be removed."""
    sums, path = _folded(spark, out), posixpath.join(out, "compacted")
    newest = sums.agg(F.max("batch_id")).first()[0]
    if newest is not None:
        folded = sums.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ADDED]).withColumn("batch_id", F.lit(newest).cast("long"))
        replace_atomically(folded, path)
        expire(spark, path, keep=2)


def read_ledger(spark: SparkSession, out: str) -> DataFrame:
    """The reservations that are not in the fact, with reason and batch."""
    return _read(spark, out, "ledger", LEDGER)


def read_reservation_fact(spark: SparkSession, out: str, with_late: bool = False) -> DataFrame:
    """The daily fact.  ``with_late`` adds the late reservations of the ledger, and how many of
    a key's reservations they are, as ``late_reservations``."""
    sums = _folded(spark, out).drop("batch_id").withColumn("late_reservations", F.lit(0).cast("long"))
    if with_late:
        late = daily_sums(read_ledger(spark, out).filter(F.col("reason") == "late"))
        sums = sums.unionByName(late.withColumn("late_reservations", F.col("total_reservations")))
    total = sums.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in (*ADDED, "late_reservations")])
    return total.select(*KEY, "bookings", "cancellations", "total_reservations", F.try_divide("adr_sum", "adr_count").alias("adr"), "room_nights",
                        *["late_reservations"] * with_late)
