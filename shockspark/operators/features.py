"""Daily aggregation and feature engineering.

Baselines are one-row aggregates attached as scalar subqueries (global form) or a
per-destination aggregate joined back (J3).  The per-destination baseline has one row
per destination; AQE turns that join into a broadcast join at run time when the
aggregate is small (runtime size check), otherwise it stays a shuffle join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shockspark.functions.exprs import div_if_positive, round_pandas, safe_div

# Phase thresholds in days after the crisis start.
IMMEDIATE_DAYS = 14
SHORT_TERM_DAYS = 90
RATIO_CAP = 1000.0


def _d(x) -> dt.date:
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(str(x)[:10])


def daily_aggregates(reservations: DataFrame, keys=("destination_id",)) -> DataFrame:
    """A1: reservations -> (date, keys): bookings (not canceled), cancellations, total
    (non-null flags), mean adr, room nights (weekend + week nights, NULL as 0)."""
    nights = F.coalesce(F.col("stays_in_weekend_nights"), F.lit(0)) + \
        F.coalesce(F.col("stays_in_week_nights"), F.lit(0))
    return reservations.groupBy(F.col("arrival_date").alias("date"), *keys).agg(
        F.count_if(F.col("is_canceled") == 0).alias("bookings"),
        F.count_if(F.col("is_canceled") == 1).alias("cancellations"),
        F.count("is_canceled").alias("total_reservations"),
        F.avg("adr").alias("adr"),
        F.sum(nights).alias("room_nights"))


def attach_searches(daily: DataFrame, searches: DataFrame | None) -> DataFrame:
    """LEFT join of (date, destination_id, search_demand) onto the daily aggregate;
    without searches the column is NULL."""
    if searches is None:
        return daily.withColumn("search_demand", F.lit(None).cast("double"))
    s = searches.select("date", "destination_id", F.col("search_demand").cast("double"))
    return daily.join(s, ["date", "destination_id"], "left")


def global_baseline(daily: DataFrame, crisis_start, baseline_days: int = 30) -> DataFrame:
    """mean bookings / adr over [start - n, start); no rows there -> the first n days
    of data; a baseline <= 0 (or undefined) -> 1.0.  One row."""
    s = _d(crisis_start)
    d = F.col("date")
    in_base = (d >= F.lit(s - dt.timedelta(days=baseline_days))) & (d < F.lit(s))
    dmin = daily.agg(F.min("date")).scalar()
    first_n = d < F.date_add(dmin, baseline_days)
    b = daily.agg(
        F.count_if(in_base).alias("n_base"),
        F.avg(F.when(in_base, F.col("bookings"))).alias("b1"), F.avg(F.when(in_base, F.col("adr"))).alias("a1"),
        F.avg(F.when(first_n, F.col("bookings"))).alias("b2"), F.avg(F.when(first_n, F.col("adr"))).alias("a2"))
    pick = lambda x, y: F.when(F.col("n_base") > 0, F.col(x)).otherwise(F.col(y))
    pos = lambda c: F.when(c > 0, c).otherwise(F.lit(1.0))
    return b.select(pos(pick("b1", "b2")).alias("baseline_bookings"), pos(pick("a1", "a2")).alias("baseline_adr"))


def crisis_phase(days_col, day0_phase: str = "immediate"):
    """pre_crisis before the start; immediate up to 14 days; short_term up to
    90; recovery after.  ``day0_phase='pre_crisis'`` gives the F6 rule, which tests the
    clipped day count and so labels the crisis day itself pre_crisis."""
    x = F.col(days_col) if isinstance(days_col, str) else days_col
    first = x < 0 if day0_phase == "immediate" else x <= 0
    return (F.when(first, "pre_crisis").when(x <= IMMEDIATE_DAYS, "immediate")
            .when(x <= SHORT_TERM_DAYS, "short_term").otherwise("recovery"))


def engineer_features(daily: DataFrame, crisis_id: int, crisis_start, baseline_days: int = 30) -> DataFrame:
    """Engineered columns with a global pre-crisis baseline."""
    s = _d(crisis_start)
    base = global_baseline(daily, s, baseline_days)
    b = base.select(F.struct("baseline_bookings", "baseline_adr")).scalar()  # one subquery
    bb, ba = b["baseline_bookings"], b["baseline_adr"]
    days = F.datediff(F.col("date"), F.lit(s))
    ratio = div_if_positive(F.coalesce(F.col("search_demand"), F.lit(0.0)), "bookings")
    return daily.withColumns({
        "bookings_per_day": F.col("bookings").cast("double"),
        "cancellation_rate": div_if_positive("cancellations", "total_reservations", 0.0),
        "search_to_booking_ratio": F.when(ratio > RATIO_CAP, F.lit(RATIO_CAP)).otherwise(ratio),
        "adr_change": (F.col("adr") - ba) / ba * 100,
        "demand_change_percent": (F.col("bookings") - bb) / bb * 100,
        "normalized_demand_index": F.col("bookings") / bb * 100,
        "crisis_phase": crisis_phase(days),
        "days_since_crisis": F.greatest(days, F.lit(0)),
        "crisis_id": F.lit(crisis_id),
    })


def no_crisis_features(daily: DataFrame) -> DataFrame:
    """features without a crisis: index 100, pre_crisis, day 0, crisis 0, no cap."""
    return daily.withColumns({
        "bookings_per_day": F.col("bookings").cast("double"),
        "cancellation_rate": div_if_positive("cancellations", "total_reservations", 0.0),
        "search_to_booking_ratio": div_if_positive(F.coalesce(F.col("search_demand"), F.lit(0.0)), "bookings"),
        "adr_change": F.lit(None).cast("double"),
        "demand_change_percent": F.lit(None).cast("double"),
        "normalized_demand_index": F.lit(100.0),
        "crisis_phase": F.lit("pre_crisis"),
        "days_since_crisis": F.lit(0),
        "crisis_id": F.lit(0),
    })


def destination_baselines(df: DataFrame, crisis_start, baseline_days: int = 30) -> DataFrame:
    """J3 input: per-destination mean bookings / adr over [start - n, start - 1]."""
    s = _d(crisis_start)
    d = F.col("date")
    pre = df.filter((d >= F.lit(s - dt.timedelta(days=baseline_days))) & (d <= F.lit(s - dt.timedelta(days=1))))
    return pre.groupBy("destination_id").agg(F.avg("bookings").alias("baseline_bookings"),
                                             F.avg("adr").alias("baseline_adr"))


def demand_to_daily_metrics(demand: DataFrame, crisis_start, baseline_days: int = 30,
                            crisis_id: int = 1) -> DataFrame:
    """demand rows (date, destination, source_market, bookings, searches,
    cancellations, adr, ...) -> fact rows with per-destination baselines (J3): missing
    baseline -> global mean, baseline bookings 0 -> 1; day 0 is 'pre_crisis'."""
    s = _d(crisis_start)
    df = demand.withColumns({
        "destination_id": F.col("destination"),
        "total_reservations": F.col("bookings") + F.col("cancellations"),
        "search_demand": F.col("searches").cast("double"),
    })
    base = destination_baselines(df, s, baseline_days)
    means = df.agg(F.struct(F.avg("bookings").alias("b"), F.avg("adr").alias("a"))).scalar()
    mean_b, mean_a = means["b"], means["a"]
    j = df.join(base, "destination_id", "left")
    bb = F.coalesce(F.col("baseline_bookings"), mean_b)
    bb = F.when(bb == 0, F.lit(1.0)).otherwise(bb)
    ba = F.coalesce(F.col("baseline_adr"), mean_a)
    days = F.greatest(F.datediff(F.col("date"), F.lit(s)), F.lit(0))
    out = j.withColumns({
        "bookings_per_day": F.col("bookings").cast("double"),
        "cancellation_rate": div_if_positive("cancellations", "total_reservations", 0.0),
        "search_to_booking_ratio": F.when(F.col("bookings") > 0, safe_div("search_demand", "bookings")),
        "adr_change": safe_div(F.col("adr") - ba, ba) * 100,
        "demand_change_percent": safe_div(F.col("bookings") - bb, bb) * 100,
        "normalized_demand_index": safe_div("bookings", bb) * 100,
        "days_since_crisis": days,
        "crisis_phase": crisis_phase(days, day0_phase="pre_crisis"),
        "crisis_id": F.lit(crisis_id),
    })
    keep = ["date", "destination_id", "crisis_id", "bookings", "cancellations", "total_reservations",
            "search_demand", "adr", "room_nights", "bookings_per_day", "cancellation_rate",
            "search_to_booking_ratio", "adr_change", "demand_change_percent", "normalized_demand_index",
            "crisis_phase", "days_since_crisis", "lead_time_days", "occupancy_rate", "source_market",
            "avg_length_of_stay", "travel_type"]
    return out.select(*[c for c in keep if c in out.columns])


def search_proxy(reservations: DataFrame, lead_days: int = 7) -> DataFrame:
    """search demand proxy per destination: the non-canceled bookings ``lead_days``
    rows ahead, forward-filled, the day's own bookings when nothing follows, floor 1,
    2 decimals (the reference's random noise factor is not reproduced)."""
    daily = reservations.groupBy("destination_id", F.col("arrival_date").alias("date")).agg(
        F.count_if(F.col("is_canceled") == 0).alias("bookings"))
    w = Window.partitionBy("destination_id").orderBy("date")
    ahead = daily.withColumn("_ahead", F.lead("bookings", lead_days).over(w))
    filled = F.last("_ahead", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    s = F.coalesce(filled, F.col("bookings")).cast("double")
    return ahead.select("date", "destination_id",
                        round_pandas(F.greatest(s, F.lit(1.0)), 2).alias("search_demand"))
