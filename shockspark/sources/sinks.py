"""Writers.

The reference replaces whole tables (DELETE then INSERT).  Here a write is a Spark
job into any DataSource; ``overwrite`` replaces the table, and the daily fact is
partitioned by month so that ``dynamic`` mode replaces only the months present in the
new data (the incremental refresh the streaming job uses).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockspark import schemas
from shockspark.functions.exprs import null_words_to_null
from shockspark.sources.versioned import read_table, replace_atomically, replace_partitions

# Columns of the stored fact table, required and optional ones.
FACT_BASE = ["date", "destination_id", "crisis_id", "bookings", "cancellations", "total_reservations",
             "search_demand", "adr", "room_nights", "bookings_per_day", "cancellation_rate",
             "search_to_booking_ratio", "adr_change", "demand_change_percent", "normalized_demand_index",
             "crisis_phase", "days_since_crisis"]
FACT_OPTIONAL = ["source_market", "avg_length_of_stay", "travel_type", "lead_time_days", "occupancy_rate"]


def conform_daily_metrics(df: DataFrame) -> DataFrame:
    """Project onto the stored fact schema: base columns (missing ones NULL), optional
    columns only when present, ``crisis_id`` NULL -> 0, types cast to the DDL."""
    types = {f.name: f.dataType for f in schemas.DAILY_METRICS.fields}
    have = set(df.columns)
    out = []
    for c in FACT_BASE:
        e = F.col(c) if c in have else F.lit(None)
        if c == "crisis_id":
            e = F.coalesce(e.cast("int"), F.lit(0))
        out.append(e.cast(types[c]).alias(c))
    out += [F.col(c).cast(types[c]).alias(c) for c in FACT_OPTIONAL if c in have]
    return df.select(*out)


def write_daily_metrics(df: DataFrame, path: str, mode: str = "overwrite", dynamic: bool = False,
                        fmt: str = "parquet") -> None:
    """K1: write the fact partitioned by month.  ``dynamic=True`` overwrites only the
    months present in ``df`` (dynamic partition overwrite).  Rows are rebalanced by month
    first, so a month becomes few files; a month larger than the advisory partition size
    is split over tasks."""
    out = conform_daily_metrics(df).withColumn("month", F.date_format("date", "yyyy-MM"))
    w = out.hint("rebalance", "month").write.mode(mode).format(fmt).partitionBy("month")
    if dynamic:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.save(path)


def read_daily_metrics(spark, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path).drop("month")


def replace_daily_metrics(df: DataFrame, path: str, months_only: bool = False) -> int:
    """K1 in one step: the fact by month as the next version of a versioned table (of only the
    months present in ``df`` with ``months_only``).  If the write fails the old table stays."""
    out = conform_daily_metrics(df).withColumn("month", F.date_format("date", "yyyy-MM"))
    return replace_partitions(out, path, "month") if months_only else replace_atomically(out, path, "month")


def read_stored_metrics(spark, path: str, version: int | None = None) -> DataFrame:
    return read_table(spark, path, version).drop("month")


def conform_destinations(df: DataFrame) -> DataFrame:
    """K2: destination dimension; a missing ``region`` becomes NULL."""
    have = set(df.columns)
    return df.select("destination_id", "destination_name",
                     (F.col("region") if "region" in have else F.lit(None)).cast("string").alias("region"))


def conform_crisis_events(df: DataFrame) -> DataFrame:
    """K2: crisis dimension; missing end date / regions become NULL."""
    have = set(df.columns)
    return df.select(
        F.col("crisis_id").cast("int"), "crisis_name", F.col("crisis_start_date").cast("date"),
        (F.col("crisis_end_date") if "crisis_end_date" in have else F.lit(None)).cast("date").alias("crisis_end_date"),
        (F.col("affected_regions") if "affected_regions" in have else F.lit(None)).cast("array<string>")
        .alias("affected_regions"))


def conform_flights(df: DataFrame) -> DataFrame:
    """K3: flights fact projected onto its schema."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schemas.FACT_FLIGHTS.fields])


def conform_visas(df: DataFrame) -> DataFrame:
    """K3: visas fact projected onto its schema."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schemas.FACT_VISAS.fields])


def replace_table(df: DataFrame, path: str, fmt: str = "parquet", options: dict | None = None) -> None:
    """K2/K3/K5: full replace of a table in any DataSource (parquet, csv, jdbc, ...)."""
    df.write.mode("overwrite").format(fmt).options(**(options or {})).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    """K4: CSV with header (forecast outputs)."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def nullify_null_words(df: DataFrame) -> DataFrame:
    """K5: strings ``nat``, ``nan``, ``none`` and empty (any case, trimmed) -> NULL."""
    return df.select(*[null_words_to_null(f.name).alias(f.name) if f.dataType.typeName() == "string"
                       else F.col(f.name) for f in df.schema.fields])


def to_json_records(df: DataFrame) -> DataFrame:
    """K6: one JSON object per row; dates as ``yyyy-MM-dd``, NaN / +-inf -> null."""
    cols = []
    for f in df.schema.fields:
        t = f.dataType.typeName()
        c = F.col(f.name)
        if t == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif t == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd")
        elif t in ("double", "float"):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))
