"""Request filters.

Filters compare the raw columns with literals (no casts around the column), so they
reach the Parquet scan as ``PushedFilters``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockspark.operators.travel import TravelContext, filter_fact


def _d(x):
    return F.lit(dt.date.fromisoformat(str(x)[:10]))


def filter_metrics(df: DataFrame, date_from=None, date_to=None, destination=None,
                   source_market=None, travel_type=None) -> DataFrame:
    """Inclusive date range and equality filters; a filter on a column the frame
    does not have is ignored."""
    cols = set(df.columns)
    if date_from:
        df = df.filter(F.col("date") >= _d(date_from))
    if date_to:
        df = df.filter(F.col("date") <= _d(date_to))
    for c, v in (("destination_id", destination), ("source_market", source_market),
                 ("travel_type", travel_type)):
        if v and c in cols:
            df = df.filter(F.col(c) == v)
    return df


def filter_facts(df: DataFrame, date_from=None, date_to=None, destination=None,
                 origin_country=None, travel_type=None) -> DataFrame:
    """P5: flights / visas filter by plain values (see ``travel.filter_fact``)."""
    return filter_fact(df, TravelContext.of(date_from, date_to, destination=destination, source_market=origin_country,
                                            travel_type=travel_type))


def period_filter(df: DataFrame, crisis_date, period: str = "all") -> DataFrame:
    """P10: all / pre (before the crisis date) / post (on or after)."""
    if period == "pre":
        return df.filter(F.col("date") < _d(crisis_date))
    if period == "post":
        return df.filter(F.col("date") >= _d(crisis_date))
    return df


def latest_rows(df: DataFrame, limit: int = 5000) -> DataFrame:
    """The newest ``limit`` rows by date, keys as tie-break (the reference relies
    on storage order).  Plans as TakeOrderedAndProject: every task keeps its own top
    ``limit`` rows, so only ``tasks x limit`` rows reach the final merge."""
    keys = [c for c in ("destination_id", "source_market", "crisis_id") if c in df.columns]
    return df.orderBy(F.col("date").desc(), *keys).limit(limit)
