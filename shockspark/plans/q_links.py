"""Catalogue entries named after SURVEY ids whose operator is part of a combined
entry elsewhere (A2, A5, A12, F2, F3, J3, J6, J9, J11, W7, X2, X3, S2), plus the crisis
CSV reader and cleaner (S3, P3) applied to the fact."""

from __future__ import annotations

from pyspark.sql import functions as F

from shockspark.operators import clean as CL
from shockspark.operators import windows as WN
# The base entries must be registered before they are projected here.
from shockspark.plans import q_features, q_forecast, q_io, q_series, q_shock  # noqa: F401
from shockspark.plans.catalog import CATALOG, register
from shockspark.session import scratch_path
from shockspark.sources import fixtures as fx
from shockspark.sources import loaders as L
from shockspark.sources.fixture_sql import with_fixtures


def _sql_of(name):
    return CATALOG[name][1]


def _project(base: str, cols_: list[str], name: str, doc: str):
    """Entry ``name`` = the columns ``cols_`` of catalogue entry ``base``."""
    fn = CATALOG[base][0]
    sql = _sql_of(base)
    wrapped = f"SELECT {', '.join(cols_)} FROM (\n{sql}\n) base_q" if sql else None

    def q(spark, sf_dir):
        return fn(spark, sf_dir).select(*cols_)

    q.__doc__ = doc
    CATALOG[name] = (q, wrapped)



_project("a3_pre_post", ["destination_id", "pre_bookings", "pre_cancellations", "pre_total", "pre_searches", "pre_adr",
                         "post_bookings", "post_cancellations", "post_total", "post_searches", "post_adr"],
         "a2_pre_post_windows", "A2: pre [s-30, s-1] and post [s, s+29] window sums and means.")
_project("a4_shock_metrics", ["destination_id", "post_booking_cv"], "a5_post_booking_cv",
         "A5: coefficient of variation of post-window bookings (0.5 when undefined, 1.0 when mean <= 0).")
_project("a11_search_booking_corr", ["spearman_rho", "n"], "a12_spearman_rho",
         "A12: Spearman rho from average ranks of the fact rows.")
_project("f4_engineer_features", ["date", "destination_id", "source_market", "bookings_per_day", "cancellation_rate",
                                  "search_to_booking_ratio"], "f2_ratio_features",
         "F2: bookings per day, cancellation rate, capped search-to-booking ratio.")
_project("f4_engineer_features", ["date", "destination_id", "source_market", "adr_change", "demand_change_percent",
                                  "normalized_demand_index"], "f3_baseline_features",
         "F3: ADR change and demand change in percent, normalized demand index (100 = baseline).")
_project("f6_destination_baseline_features", ["date", "destination_id", "adr_change", "demand_change_percent",
                                              "normalized_demand_index"], "j3_destination_baseline_join",
         "J3: per-destination baseline left-joined (missing -> global mean, 0 -> 1).")
_project("a9_sankey_flows", ["source", "target", "value"], "j6_losers_gainers_pairs",
         "J6: pairs of the top losers and top gainers (k x k, from two limit(k) frames).")
_project("a24_ota_kpis", ["destination_id", "bookings", "avg_lead_time_days"], "j11_lead_time_in_group",
         "J11: mean lead time folded into the same group-by instead of a LEFT join.")
_project("m7_recovery_timeline", ["destination_id", "recovery_50_date", "recovery_90_date", "recovery_100_date"],
         "w7_first_recovery_dates", "W7: first post-crisis date at or above each recovery target.")
_project("x1_x4_rolling_features", ["destination_id", "date", "search_lag14"], "x2_search_lag14",
         "X2 (documented extra): searches 14 days earlier on the gap-free series.")
_project("x1_x4_rolling_features", ["destination_id", "date", "cancellation_rate_30d", "bookings_vol_30d"],
         "x3_x4_rolling_30d", "X3, X4 (documented extras): 30-day cancellation rate and volatility.")
_project("p2_search_demand_roundtrip", ["date", "destination_id", "search_demand"], "s2_load_search_demand",
         "S2: searches CSV with the ``searches`` column name read back as ``search_demand``.")


def crisis_csv(spark, sf_dir) -> str:
    """The crisis table in the extended landing layout (``region_affected`` with ``;``
    lists, an unparsable end date) plus an incomplete row the cleaner must drop."""
    c = fx.crisis_events(spark)
    rows = c.select(F.col("crisis_id").cast("string").alias("crisis_id"), "crisis_name",
                    F.col("crisis_start_date").cast("string").alias("crisis_start_date"),
                    F.coalesce(F.col("crisis_end_date").cast("string"), F.lit("open")).alias("crisis_end_date"),
                    F.array_join("affected_regions", ";").alias("region_affected"))
    bad = spark.createDataFrame([("", "No id", "1999-01-01", "", "")], rows.schema)
    path = scratch_path(spark, "crisis-csv")
    rows.unionByName(bad).write.option("header", "true").csv(path)
    return path


@register("s3_p3_crisis_csv_on_fact", with_fixtures("", """
SELECT c.crisis_id, c.crisis_name, c.crisis_start_date, c.crisis_end_date,
  CAST(COALESCE(SUM(m.bookings), 0) AS BIGINT) AS bookings, COUNT(m.date) AS row_count
FROM crisis_events c LEFT JOIN daily_metrics m
  ON m.date >= c.crisis_start_date AND (c.crisis_end_date IS NULL OR m.date <= c.crisis_end_date)
GROUP BY 1, 2, 3, 4"""))
def s3_p3_crisis_csv_on_fact(spark, sf_dir):
    """S3 + P3: crisis CSV (extended layout, bad end date -> NULL) loaded, incomplete
    rows dropped, then the fact rows inside each crisis period counted (J7 range join,
    grouped per crisis)."""
    c = CL.clean_crisis_events(L.load_crisis_events(spark, crisis_csv(spark, sf_dir)))
    m = fx.daily_metrics(spark, sf_dir).select("date", "bookings")
    active = WN.crises_active_on(m, c)
    per = active.groupBy("crisis_id").agg(F.sum("bookings").alias("bookings"), F.count("date").alias("row_count"))
    out = c.select("crisis_id", "crisis_name", "crisis_start_date", "crisis_end_date").join(per, "crisis_id", "left")
    return out.select("crisis_id", "crisis_name", "crisis_start_date", "crisis_end_date",
                      F.coalesce("bookings", F.lit(0)).cast("bigint").alias("bookings"),
                      F.coalesce("row_count", F.lit(0)).alias("row_count"))

