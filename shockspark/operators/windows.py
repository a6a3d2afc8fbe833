"""Crisis windows: the pre / post periods around a crisis start.

Two forms:

* ``CrisisWindow`` – literal dates.  Used when the caller names one crisis; the date
  range becomes a literal filter that reaches the Parquet scan (row-group skipping,
  partition pruning on a date-partitioned fact).
* ``window_days`` – a frame ``(crisis_id, date, is_pre, is_post)`` with one row per day
  of every crisis window.  Joining it on ``date`` is an *equi*-join, so all crises are
  analysed in one scan without a nested-loop range join.  Its size is
  crises x (pre + post) days and is checked before it is broadcast.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockspark.functions.broadcast import bounded_broadcast
from shockspark.operators.cumulative import running_totals, window_totals

PRE_CRISIS_DAYS = 30
POST_CRISIS_DAYS = 30


def _as_date(d) -> dt.date:
    if isinstance(d, dt.datetime):
        return d.date()
    if isinstance(d, dt.date):
        return d
    return dt.date.fromisoformat(str(d)[:10])


@dataclass(frozen=True)
class CrisisWindow:
    """pre = [start - pre_days, start - 1], post = [start, start + post_days - 1]."""

    crisis_start: dt.date
    pre_days: int = PRE_CRISIS_DAYS
    post_days: int = POST_CRISIS_DAYS

    @staticmethod
    def of(start, pre_days: int = PRE_CRISIS_DAYS, post_days: int = POST_CRISIS_DAYS) -> "CrisisWindow":
        return CrisisWindow(_as_date(start), pre_days, post_days)

    @property
    def pre_start(self) -> dt.date:
        return self.crisis_start - dt.timedelta(days=self.pre_days)

    @property
    def pre_end(self) -> dt.date:
        return self.crisis_start - dt.timedelta(days=1)

    @property
    def post_start(self) -> dt.date:
        return self.crisis_start

    @property
    def post_end(self) -> dt.date:
        return self.crisis_start + dt.timedelta(days=self.post_days - 1)

    def is_pre(self, date_col="date"):
        d = F.col(date_col)
        return (d >= F.lit(self.pre_start)) & (d <= F.lit(self.pre_end))

    def is_post(self, date_col="date"):
        d = F.col(date_col)
        return (d >= F.lit(self.post_start)) & (d <= F.lit(self.post_end))

    def in_window(self, date_col="date"):
        d = F.col(date_col)
        return (d >= F.lit(self.pre_start)) & (d <= F.lit(self.post_end))


def crisis_windows(crises: DataFrame, pre_days: int = PRE_CRISIS_DAYS,
                   post_days: int = POST_CRISIS_DAYS) -> DataFrame:
    """One row per crisis with its window bounds."""
    s = F.col("crisis_start_date")
    return crises.select(
        "crisis_id", "crisis_name", s.alias("crisis_start"),
        F.date_sub(s, pre_days).alias("pre_start"), F.date_sub(s, 1).alias("pre_end"),
        s.alias("post_start"), F.date_add(s, post_days - 1).alias("post_end"))


def window_days(crises: DataFrame, pre_days: int = PRE_CRISIS_DAYS,
                post_days: int = POST_CRISIS_DAYS) -> DataFrame:
    """Every day of every crisis window, flagged pre / post; size-checked broadcast."""
    w = crisis_windows(crises, pre_days, post_days)
    days = w.select("crisis_id", "crisis_start",
                    F.explode(F.sequence("pre_start", "post_end")).alias("date"))
    days = days.select("crisis_id", "crisis_start", "date",
                       (F.col("date") < F.col("crisis_start")).alias("is_pre"),
                       (F.col("date") >= F.col("crisis_start")).alias("is_post"))
    return bounded_broadcast(days)


def crisis_totals(fact: DataFrame, crises: DataFrame, measures: dict, key: str = "destination_id", pre_days: int = PRE_CRISIS_DAYS,
                  post_days: int = POST_CRISIS_DAYS) -> DataFrame:
    """SURVEY J4 by running totals: the sums of ``measures`` before and after every crisis
    for every key, two look-ups a side instead of the fact's rows of each crisis window."""
    totals = running_totals(fact.filter(F.col(key).isNotNull()), measures, (key,))
    w = crisis_windows(crises, pre_days, post_days)
    sides = w.select("crisis_id", F.explode(F.array(
        F.struct(F.lit("pre").alias("side"), F.col("pre_start").alias("date_from"), F.col("pre_end").alias("date_to")),
        F.struct(F.lit("post").alias("side"), F.col("post_start").alias("date_from"), F.col("post_end").alias("date_to")))).alias("w")).select("crisis_id", "w.*")
    found = window_totals(totals, sides, list(measures), (key,))
    return found.groupBy(key, "crisis_id").agg(*[F.sum(F.when(F.col("side") == side, F.col(m))).alias(f"{side}_{m}")
                                                 for side in ("pre", "post") for m in measures])


def lookup_crisis(crises: DataFrame, crisis_id: int | None = None) -> DataFrame:
    """SURVEY P6: the crisis with ``crisis_id``; an unknown (or no) id gives the earliest
    crisis.  One aggregate over the crisis table, returns one row."""
    row = F.struct("crisis_start_date", "crisis_id", "crisis_name", "crisis_end_date")
    first = F.min_by(row, F.struct("crisis_start_date", "crisis_id"))
    if crisis_id is None:
        pick = first
    else:
        match = F.first(F.when(F.col("crisis_id") == crisis_id, row), ignorenulls=True)
        pick = F.coalesce(match, first)
    return crises.agg(pick.alias("c")).select(
        "c.crisis_id", "c.crisis_name", "c.crisis_start_date", "c.crisis_end_date")


def effective_window(crises: DataFrame, crisis_id: int | None = None, date_from=None,
                     date_to=None) -> DataFrame:
    """SURVEY P7: (start, end) of the analysis; explicit dates win over crisis dates."""
    c = lookup_crisis(crises, crisis_id)
    return c.select(
        "crisis_id",
        F.coalesce(F.lit(_as_date(date_from)) if date_from else F.lit(None).cast("date"),
                   F.col("crisis_start_date")).alias("window_start"),
        F.coalesce(F.lit(_as_date(date_to)) if date_to else F.lit(None).cast("date"),
                   F.col("crisis_end_date")).alias("window_end"))


def crisis_presets(crises: DataFrame, months: int = 3) -> DataFrame:
    """SURVEY P8: UI preset range start -/+ ``months`` (Spark clamps month ends)."""
    s = F.col("crisis_start_date")
    return crises.select("crisis_id", "crisis_name",
                         F.add_months(s, -months).alias("date_from"),
                         F.add_months(s, months).alias("date_to"))


def latest_crisis_matching(crises: DataFrame, pattern: str) -> DataFrame:
    """SURVEY P9: newest crisis whose name or regions contain ``pattern`` (case-insensitive)."""
    p = pattern.lower()
    regions = F.lower(F.coalesce(F.array_join("affected_regions", ","), F.lit("")))
    hit = F.lower(F.col("crisis_name")).contains(p) | regions.contains(p)
    row = F.struct("crisis_id", "crisis_name", "crisis_start_date")
    return crises.filter(hit).agg(
        F.max_by(row, F.struct("crisis_start_date", "crisis_id")).alias("c")).filter(
        F.col("c").isNotNull()).select("c.*")


def crises_active_on(dates: DataFrame, crises: DataFrame, date_col: str = "date") -> DataFrame:
    """SURVEY J7: crises active on each date (start <= d and (end is null or end >= d)).

    Every crisis is expanded to its days, clipped to the first and last date of
    ``dates``, and joined by equality on the day; a crisis without an end lasts until the
    last date.  The day table has at most crises x days rows and is broadcast behind a
    check of its row count."""
    span = dates.agg(F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi"))
    clipped = crises.select("crisis_id", "crisis_name", "crisis_start_date", "crisis_end_date",
                            span.select("_lo").scalar().alias("_lo"), span.select("_hi").scalar().alias("_hi")).select(
        "crisis_id", "crisis_name", "crisis_start_date", "crisis_end_date",
        F.greatest("crisis_start_date", "_lo").alias("_from"),
        F.least(F.coalesce("crisis_end_date", "_hi"), F.col("_hi")).alias("_to"))
    days = clipped.filter(F.col("_from") <= F.col("_to")).select(
        "crisis_id", "crisis_name", "crisis_start_date", "crisis_end_date",
        F.explode(F.sequence("_from", "_to")).alias(date_col))
    c = bounded_broadcast(days)
    return dates.join(c, date_col).select(
        *dates.columns, "crisis_id", "crisis_name", "crisis_start_date", "crisis_end_date")
