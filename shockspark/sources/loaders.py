"""Readers of the landing formats.

Every reader takes an explicit schema (no inference pass over the data) and returns a
lazy DataFrame; file listing and splitting are Spark's.  Optional columns are resolved
against the file header when the plan is built.
"""

from __future__ import annotations

import posixpath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shockspark import schemas

CSV_OPTS = {"header": "true", "mode": "PERMISSIVE"}


def _if_present(read):
    """``read()``, or None when its path does not exist.  The path is looked up by Spark,
    so it may be in any store that Spark reads."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV landing folder/file (reads the first line only)."""
    first = spark.read.option("header", "true").csv(path).schema
    return [f.name for f in first.fields]


def load_hotel_bookings(spark: SparkSession, path: str) -> DataFrame:
    """Hotel bookings CSV; ``arrival_date`` from year + month + day where the month
    is a name (``July``) or a number (``7``); unparsable -> NULL."""
    df = spark.read.options(**CSV_OPTS).schema(schemas.HOTEL_BOOKINGS_CSV).csv(path)
    y, m, d = (F.trim(F.col(c)) for c in ("arrival_date_year", "arrival_date_month",
                                          "arrival_date_day_of_month"))
    s = F.concat_ws("-", y, m, d)
    arrival = F.coalesce(F.try_to_date(s, "yyyy-MMMM-d"), F.try_to_date(s, "yyyy-M-d"))
    ints = ["is_canceled", "lead_time", "arrival_date_year", "arrival_date_day_of_month",
            "stays_in_weekend_nights", "stays_in_week_nights", "adults", "children"]
    return df.select(
        "hotel", *[F.col(c).try_cast("int").alias(c) for c in ints],
        "arrival_date_month", "country", F.col("adr").try_cast("double").alias("adr"),
        "reservation_status", arrival.alias("arrival_date"))


def load_search_demand(spark: SparkSession, path: str) -> DataFrame:
    """Search demand CSV with ``searches`` or ``search_demand``; values stay strings
    for ``clean_search_demand`` to coerce."""
    cols = _header(spark, path)
    value = "search_demand" if "search_demand" in cols else "searches"
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])
    df = spark.read.options(**CSV_OPTS).schema(schema).csv(path)
    return df.select(F.col("date").try_cast("date").alias("date"), "destination_id",
                     F.col(value).alias("search_demand"))


def load_crisis_events(spark: SparkSession, path: str) -> DataFrame:
    """S3: crisis events CSV.  A bad end date becomes NULL; the extended file's
    ``region_affected`` (``;`` list) maps to ``affected_regions``; lists split on ``;``
    or ``,``."""
    cols = _header(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])
    df = spark.read.options(**CSV_OPTS).schema(schema).csv(path)
    regions = "affected_regions" if "affected_regions" in cols else (
        "region_affected" if "region_affected" in cols else None)
    reg = F.col(regions) if regions else F.lit(None).cast("string")
    end = F.col("crisis_end_date") if "crisis_end_date" in cols else F.lit(None).cast("string")
    return df.select(
        F.col("crisis_id").try_cast("int").alias("crisis_id"), "crisis_name",
        F.col("crisis_start_date").try_cast("date").alias("crisis_start_date"),
        end.try_cast("date").alias("crisis_end_date"),
        F.when(reg.isNotNull(), F.transform(F.split(reg, "[;,]"), lambda x: F.trim(x)))
         .alias("affected_regions"))


def load_destinations(spark: SparkSession, path: str | None, fact: DataFrame | None = None) -> DataFrame:
    """Destinations CSV; without a file, the distinct destinations of the fact
    (name = id, no region)."""
    found = _if_present(lambda: spark.read.options(**CSV_OPTS).schema(schemas.DESTINATIONS).csv(path)) if path else None
    if found is not None:
        return found
    if fact is None:
        raise FileNotFoundError(path)
    return fact.select("destination_id").distinct().select(
        "destination_id", F.col("destination_id").alias("destination_name"),
        F.lit(None).cast("string").alias("region"))


def load_demand_csv(spark: SparkSession, path: str) -> DataFrame:
    """One row per (date, destination, source_market) demand CSV."""
    return spark.read.options(**CSV_OPTS).schema(schemas.DEMAND_CSV).csv(path)


def load_flights_csv(spark: SparkSession, path: str) -> DataFrame:
    """Flights fact CSV."""
    return spark.read.options(**CSV_OPTS).schema(schemas.FACT_FLIGHTS).csv(path)


def load_visas_csv(spark: SparkSession, path: str) -> DataFrame:
    """Visas fact CSV."""
    return spark.read.options(**CSV_OPTS).schema(schemas.FACT_VISAS).csv(path)


def load_db(spark: SparkSession, root: str, date_from=None, date_to=None) -> dict[str, DataFrame]:
    """The store (Parquet folders ``daily_metrics``, ``crisis_events``,
    ``destinations``): fact with the date range as a pushed-down filter and its months as
    a partition filter, crises ordered by start date."""
    fact = spark.read.parquet(posixpath.join(root, "daily_metrics"))
    for bound, keep in ((date_from, lambda c, v: c >= v), (date_to, lambda c, v: c <= v)):
        if bound:
            day = F.lit(bound).cast("date")
            fact = fact.filter(keep(F.col("date"), day))
            if "month" in fact.columns:
                fact = fact.filter(keep(F.col("month"), F.lit(str(bound)[:7])))
    out = {"daily_metrics": fact}
    for name in ("crisis_events", "destinations"):
        found = _if_present(lambda: spark.read.parquet(posixpath.join(root, name)))
        if found is not None:
            out[name] = found
    if "crisis_events" in out:
        out["crisis_events"] = out["crisis_events"].orderBy("crisis_start_date", "crisis_id")
    return out


def load_forecast_data(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The three forecast outputs (CSV with header); a missing file is skipped."""
    files = {"forecast_dataset": schemas.FORECAST_OUTPUT, "forecast_accuracy": schemas.FORECAST_ACCURACY,
             "crisis_recovery_timeline": schemas.RECOVERY_TIMELINE}
    out = {}
    for name, schema in files.items():
        found = _if_present(lambda: spark.read.options(**CSV_OPTS).schema(schema).csv(posixpath.join(root, name)))
        if found is not None:
            out[name] = found
    return out


INDICATOR_ITEM = ("array<struct<country:struct<id:string,value:string>,"
                  "date:string,value:double>>")


def load_indicator_json(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """Indicator JSON pages ``[meta, [{country: {id, value}, date, value}, ...]]`` ->
    (country_code, country_name, year, arrivals); NULL values dropped.

    Default: one page document per line (splittable, parallel over lines and files).
    ``whole_file=True`` reads one document per file, as saved from the web API."""
    reader = spark.read.option("wholetext", "true") if whole_file else spark.read
    pages = reader.text(path)
    v = F.parse_json("value")
    items = pages.select(F.explode(F.variant_get(v, "$[1]", INDICATOR_ITEM)).alias("it"))
    return items.filter(F.col("it.value").isNotNull()).select(
        F.col("it.country.id").alias("country_code"),
        F.col("it.country.value").alias("country_name"),
        F.col("it.date").try_cast("int").alias("year"),
        F.col("it.value").alias("arrivals"))
