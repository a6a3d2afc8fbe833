"""Data-quality checks of the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACT_KEY = ["date", "destination_id", "source_market", "crisis_id"]
FACT_NOT_NULL = ["date", "destination_id", "bookings_per_day", "cancellation_rate"]


def key_and_null_checks(df: DataFrame, key=FACT_KEY, not_null=FACT_NOT_NULL) -> DataFrame:
    """K7: rows, distinct keys, duplicated key groups and NULL counts per NOT NULL
    column, in one row.  Duplicates come from a ``groupBy(key)`` with partial
    aggregation; NULL counts from one ``agg`` over the table."""
    present = [c for c in not_null if c in df.columns]
    nulls = df.agg(F.count(F.lit(1)).alias("rows"),
                   *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in present])
    dup = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(F.col("_n") > 1).alias("duplicate_keys"))
    d = dup.select(F.struct("distinct_keys", "duplicate_keys")).scalar()  # one subquery
    return nulls.select("*", d["distinct_keys"].alias("distinct_keys"), d["duplicate_keys"].alias("duplicate_keys"))


def reconcile_counts(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """K5: row count of each table in the source and the copy, and whether they agree.
    One small aggregate per table, stacked with ``unionByName``."""
    parts = []
    for name, (src, dst) in pairs.items():
        parts.append(src.agg(F.count(F.lit(1)).alias("source_rows")).select(
            F.lit(name).alias("table_name"), "source_rows",
            dst.agg(F.count(F.lit(1))).scalar().alias("target_rows")))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.withColumn("match", F.col("source_rows") == F.col("target_rows"))
