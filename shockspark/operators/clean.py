"""Cleaning of the landing data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockspark.functions.quantiles import median_and_filled_quantile, quantiles


def _scalar(one_row: DataFrame):
    """The single value of a one-row, one-column aggregate (a number, not data)."""
    return one_row.first()[0]


def clean_hotel_bookings(df: DataFrame, year_from: int = 2015, year_to: int = 2030,
                         approx: bool = False) -> DataFrame:
    """Drop rows without a date, keep years in [year_from, year_to]; a NULL adr
    becomes the median, then adr is clipped to [0, p99] where p99 is taken after the
    fill; nights NULL -> 0 and >= 0; is_canceled in {0, 1}.

    Median and p99 are exact (linear interpolation) by default, computed as distributed
    one-row aggregates (``functions.quantiles``); ``approx=True`` uses
    ``percentile_approx``."""
    d = df.filter(F.col("arrival_date").isNotNull()).filter(
        F.year("arrival_date").between(year_from, year_to))
    cols = set(d.columns)
    if "adr" in cols:
        # Two scalars from distributed aggregates, evaluated when the plan is built and
        # applied as literals: as nested scalar subqueries the p99 (over values filled
        # with the median) would re-plan the median's whole pipeline inside its own.
        if approx:
            med = _scalar(quantiles(d, "adr", {"m": 0.5}, approx=True))
            filled = d.withColumn("adr", F.coalesce(F.col("adr"), F.lit(med).cast("double")))
            p99 = _scalar(quantiles(filled, "adr", {"p": 0.99}, approx=True))
        else:
            med, p99 = median_and_filled_quantile(d, "adr", 0.99)
        d = d.withColumn("adr", F.coalesce(F.col("adr"), F.lit(med).cast("double")))
        a = F.col("adr")
        if p99 is not None:
            d = d.withColumn("adr", F.when(a < 0, F.lit(0.0)).when(a > F.lit(p99), F.lit(p99)).otherwise(a))
        else:
            d = d.withColumn("adr", F.when(a < 0, F.lit(0.0)).otherwise(a))
    for c in ("stays_in_weekend_nights", "stays_in_week_nights"):
        if c in cols:
            d = d.withColumn(c, F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)))
    if "is_canceled" in cols:
        d = d.withColumn("is_canceled",
                         F.least(F.greatest(F.coalesce(F.col("is_canceled").cast("int"), F.lit(0)), F.lit(0)),
                                 F.lit(1)))
    return d


def clean_search_demand(df: DataFrame) -> DataFrame:
    """Numeric coercion (unparsable -> 0), NULL -> 0, negative -> 0; rows without
    date or destination dropped; both ``search_demand`` and ``searches`` present."""
    v = F.greatest(F.coalesce(F.col("search_demand").try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return (df.withColumn("search_demand", v).withColumn("searches", F.col("search_demand"))
            .dropna(subset=["date", "destination_id"]))


def clean_crisis_events(df: DataFrame) -> DataFrame:
    """Drop crises without id, name or start date."""
    return df.dropna(subset=["crisis_id", "crisis_name", "crisis_start_date"])
