"""Oracle SQL for the shock family (independent SQL text, DuckDB dialect)."""

from __future__ import annotations

from shockspark.operators.windows import CrisisWindow
from shockspark.plans.sqlkit import cols, d, window_where


def pre_post_cte(w: CrisisWindow, name: str = "pp", keys: str = "destination_id",
                 source: str = "daily_metrics") -> str:
    s = d(w.crisis_start)

    def side(flag, p):
        has = f"COUNT(*) FILTER (WHERE {flag}) > 0"
        return f"""
    CASE WHEN {has} THEN CAST(COALESCE(SUM(bookings) FILTER (WHERE {flag}), 0) AS BIGINT) END AS {p}_bookings,
    CASE WHEN {has} THEN CAST(COALESCE(SUM(cancellations) FILTER (WHERE {flag}), 0) AS BIGINT) END AS {p}_cancellations,
    CASE WHEN {has} THEN CAST(COALESCE(SUM(total_reservations) FILTER (WHERE {flag}), 0) AS BIGINT) END AS {p}_total,
    CASE WHEN {has} THEN COALESCE(SUM(search_demand) FILTER (WHERE {flag}), 0) END AS {p}_searches,
    AVG(adr) FILTER (WHERE {flag}) AS {p}_adr"""

    return f"""{name} AS (
  SELECT {keys},{side(f'date < {s}', 'pre')},{side(f'date >= {s}', 'post')},
    AVG(bookings) FILTER (WHERE date >= {s}) AS post_mean_,
    STDDEV_SAMP(bookings) FILTER (WHERE date >= {s}) AS post_std_,
    COUNT(*) FILTER (WHERE date >= {s}) AS post_rows_
  FROM {source}
  WHERE {window_where(w)}
  GROUP BY {keys}
)"""


def shock_cte(w: CrisisWindow, name: str = "shock", keys: str = "destination_id") -> str:
    """Python-form shock metrics (fractions), one row per key."""
    return pre_post_cte(w, "pp_" + name, keys) + f""",
{name} AS (
  SELECT {keys}, pre_bookings, pre_cancellations, pre_total, pre_searches, pre_adr,
    post_bookings, post_cancellations, post_total, post_searches, post_adr,
    CASE WHEN pre_total > 0 THEN pre_cancellations / pre_total ELSE 0.0 END AS pre_cancellation_rate,
    CASE WHEN post_total > 0 THEN post_cancellations / post_total ELSE 0.0 END AS post_cancellation_rate,
    (post_bookings - pre_bookings) / NULLIF(pre_bookings, 0) AS booking_change_pct,
    (post_searches - pre_searches) / NULLIF(pre_searches, 0) AS search_change_pct,
    (post_adr - pre_adr) / NULLIF(pre_adr, 0) AS adr_change_pct,
    (CASE WHEN post_total > 0 THEN post_cancellations / post_total ELSE 0.0 END)
      - (CASE WHEN pre_total > 0 THEN pre_cancellations / pre_total ELSE 0.0 END) AS cancellation_spike,
    CASE WHEN post_rows_ = 0 THEN 0.5 WHEN post_mean_ > 0 THEN COALESCE(post_std_ / post_mean_, 0.5)
         ELSE 1.0 END AS post_booking_cv
  FROM pp_{name}
)"""


SHOCK_SELECT = cols(
    "destination_id", "pre_bookings", "pre_cancellations", "pre_total", "pre_searches:d", "pre_adr:d",
    "post_bookings", "post_cancellations", "post_total", "post_searches:d", "post_adr:d",
    "pre_cancellation_rate:d", "post_cancellation_rate:d", "booking_change_pct:d", "search_change_pct:d",
    "adr_change_pct:d", "cancellation_spike:d", "post_booking_cv:d")


def stab(x: str) -> str:
    v = f"(({x}) / (1 + abs(({x}) - 1) * 0.5))"
    return f"(CASE WHEN {v} > 1.0 THEN 1.0 ELSE {v} END)"


def clip(x: str, lo=None, hi=None) -> str:
    out = f"({x})"
    if lo is not None:
        out = f"(CASE WHEN {out} < {lo} THEN {lo} ELSE {out} END)"
    if hi is not None:
        out = f"(CASE WHEN {out} > {hi} THEN {hi} ELSE {out} END)"
    return out


def resilience_cte(src: str = "shock", name: str = "res") -> str:
    ratio_b = clip("CASE WHEN pre_bookings > 0 THEN post_bookings / pre_bookings ELSE 0.0 END", lo=0.0)
    ratio_s = clip("post_searches / NULLIF(pre_searches, 0)", lo=0.0)
    return f"""{name}_c AS (
  SELECT *,
    {stab(ratio_b)} AS booking_recovery_score,
    CASE WHEN pre_searches IS NOT NULL AND pre_searches > 0 THEN {stab(ratio_s)} ELSE 0.5 END AS search_demand_score,
    CASE WHEN adr_change_pct IS NOT NULL THEN {clip('1 + adr_change_pct', 0.0, 1.0)} ELSE 0.5 END AS adr_stability_score,
    1 - {clip('cancellation_spike', 0.0, 1.0)} AS cancellation_resilience,
    1 - {clip('post_booking_cv', 0.0, 1.0)} AS demand_volatility_score
  FROM {src}
),
{name} AS (
  SELECT *, 0.30 * booking_recovery_score + 0.20 * search_demand_score + 0.15 * adr_stability_score
           + 0.15 * cancellation_resilience + 0.20 * demand_volatility_score AS resilience_score
  FROM {name}_c
)"""


RESILIENCE_SELECT = SHOCK_SELECT + ",\n  " + cols(
    "booking_recovery_score:d", "search_demand_score:d", "adr_stability_score:d",
    "cancellation_resilience:d", "demand_volatility_score:d", "resilience_score:d")
