"""Totals of any number of date windows from running totals.

``running_totals`` reads the fact once and keeps, for each key and day with rows, the totals
of all days up to it: at most one row for each key and calendar day, however many fact rows
there are.  The total of a window is then the difference of two look-ups: at its last day,
and at the day before its first.  A look-up needs the newest day at or before a date, so the
dates that windows ask for are merged into the days of their key once (again at most one row
for each key and calendar day) and filled forward; windows then join by equality.  Nothing
is expanded to days, and the cost of a window does not depend on its length.

Whole numbers are added as long, other numbers as decimals of ``PLACES`` places, so that a
difference of running totals is the sum itself, in any order of addition; values that are not
finite count as missing.  Rows without a date are left out; a null key is a key.  A window
without a first or last day is open there; one that ends before it begins, or meets no rows,
has total 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = 9
DAY = "_day"


def _exact(df: DataFrame, value: Column) -> Column:
    kind = df.select(value.alias("v")).schema["v"].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return value.cast("bigint")
    if kind in ("float", "double"):
        value = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    return value.cast(f"decimal(28,{PLACES})")


def running_totals(df: DataFrame, measures: dict[str, Column], keys: tuple[str, ...] = (), date: str = "date") -> DataFrame:
    """(keys, ``_day``, measures): totals of all days up to and with each day."""
    exact = df.select(*keys, F.col(date).cast("date").alias(DAY), *[_exact(df, v).alias(n) for n, v in measures.items()])
    daily = exact.filter(F.col(DAY).isNotNull()).groupBy(*keys, DAY).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in measures])
    up_to = _series(keys).rowsBetween(Window.unboundedPreceding, 0)
    kinds = {n: "bigint" if exact.schema[n].dataType.simpleString() == "bigint" else f"decimal(37,{PLACES})" for n in measures}
    return daily.select(*keys, DAY, *[F.sum(n).over(up_to).cast(kinds[n]).alias(n) for n in measures])


def _series(keys, *further):
    """Days of one key: a series is bounded by the calendar."""
    return Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy(DAY, *further)


def window_totals(totals: DataFrame, windows: DataFrame, measures: list[str], keys: tuple[str, ...] = (), first: str = "date_from",
                  last: str = "date_to") -> DataFrame:
    """``windows`` with the totals of each window as columns ``measures``.  Windows that carry
    the ``keys`` look their key up; windows that carry none of them are looked up for every
    key of ``totals`` (their number must then be small: they go to every key as one list)."""
    carried = [k for k in keys if k in windows.columns]
    if carried and len(carried) < len(keys):
        raise ValueError(f"windows carry {carried} of the keys {list(keys)}: all or none")
    if keys and not carried:
        fields = windows.columns
        listed = windows.agg(F.collect_list(F.struct(*fields)).alias("w"))
        windows = totals.select(*keys).distinct().withColumn("w", F.explode(listed.scalar())).select(*keys, *[F.col("w")[c].alias(c) for c in fields])
    # an open end is the end of the calendar, an open start has nothing before it
    ends = {"_at_last": F.coalesce(F.col(last), F.lit("9999-12-31").cast("date")), "_at_first": F.date_sub(first, 1)}
    asked = windows.withColumns(ends)
    points = asked.select(*keys, F.explode(F.array("_at_last", "_at_first")).alias(DAY)).filter(F.col(DAY).isNotNull()).distinct()
    known = totals.select(*keys, DAY, *measures, F.lit(False).alias("_asked"))
    merged = known.unionByName(points.select(*keys, DAY, *[F.lit(None).cast(totals.schema[m].dataType).alias(m) for m in measures], F.lit(True).alias("_asked")))
    so_far = _series(keys, "_asked").rowsBetween(Window.unboundedPreceding, 0)
    found = merged.select(*keys, DAY, "_asked", *[F.last(m, ignorenulls=True).over(so_far).alias(m) for m in measures]).filter("_asked").drop("_asked")

    def look_up(df: DataFrame, at: str, suffix: str) -> DataFrame:
        side = found.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(DAY).alias("_point"), *[F.col(m).alias(m + suffix) for m in measures])
        on = F.col(at) == F.col("_point")
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        return df.join(side, on, "left").drop("_point", *[f"_{k}" for k in keys])

    both = look_up(look_up(asked, "_at_last", "_l"), "_at_first", "_f")
    value = lambda m: F.coalesce(F.col(m + "_l"), F.lit(0)) - F.coalesce(F.col(m + "_f"), F.lit(0))
    kind = lambda m: "bigint" if totals.schema[m].dataType.simpleString() == "bigint" else "double"
    backward = F.coalesce(F.col(last) < F.col(first), F.lit(False))
    return both.select(*windows.columns, *[F.when(backward, 0).otherwise(value(m)).cast(kind(m)).alias(m) for m in measures])
