"""Global ranks without a single-partition window.

``rank() over (order by v)`` with no partition key moves every row into one task.  Here
the values are cut at approximate quantiles: an odd range number stands for the rows
that equal a cut, an even one for the rows between two cuts.  A value that holds many
rows is itself a cut, and all its rows share one rank, so a hot value needs no window;
the rows between two cuts are few and are ranked in one window partition.  Exact counts
per range (partial aggregation, one row per range) give the ranks' offsets, so where the
approximate cuts fall decides which task sorts which rows, not the result.

The only single-task step handles one row per range; the number of ranges is the
session's number of shuffle partitions and a row finds its range by binary search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shockspark.session import cut_lineage


def _ranged(df: DataFrame, value_col: str, ranges: int | None) -> DataFrame:
    """``df`` (no null values) with ``_r``: 2 i between the cuts i - 1 and i, 2 i + 1 on
    cut i."""
    n = max(2, ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    v = F.col(value_col)
    cuts = df.agg(F.array_distinct(F.percentile_approx(value_col, [i / n for i in range(1, n)], 10 * n))).scalar()
    halves = F.array(*[F.lit((1 << n.bit_length()) >> i) for i in range(1, n.bit_length() + 1)])
    # The cuts are projected first: a subquery may not sit inside a higher-order function.
    low = F.aggregate(halves, F.lit(0), lambda at, half: F.when(
        F.coalesce(F.get("_cuts", at + half - 1) < v, F.lit(False)), at + half).otherwise(at))
    found = df.withColumn("_cuts", cuts).withColumn("_low", low)
    on_cut = F.coalesce(F.get("_cuts", F.col("_low")) == v, F.lit(False))
    return found.withColumn("_r", F.col("_low") * 2 + on_cut.cast("int")).drop("_cuts", "_low")


def _offsets(ranged: DataFrame, count, descending: bool) -> DataFrame:
    """(_r, _off): rows in all ranges ordered before a range; one row per range."""
    order = F.col("_r").desc() if descending else F.col("_r").asc()
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_r").agg(count.alias("_tot"))
    return F.broadcast(totals.select("_r", F.coalesce(F.sum("_tot").over(w), F.lit(0)).alias("_off")))


def value_positions(df: DataFrame, value_col: str, descending: bool = False,
                    ranges: int | None = None, weight: str | None = None) -> DataFrame:
    """Distinct non-null values of ``value_col`` with ``_k`` (rows holding the value, or the
    sum of the column ``weight``) and ``_before`` (the same of all values ordered before
    it)."""
    v = F.col(value_col)
    counts = df.filter(v.isNotNull()).groupBy(value_col).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("_k"))
    ranged = _ranged(counts, value_col, ranges)
    order = v.desc() if descending else v.asc()
    w = Window.partitionBy("_r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(F.sum("_k").over(w), F.lit(0)))
    return local.join(_offsets(ranged, F.sum("_k"), descending), "_r").select(
        value_col, "_k", (F.col("_off") + F.col("_local")).alias("_before"))


def with_rank(df: DataFrame, value_col: str, rank_col: str, descending: bool = True,
              ranges: int | None = None) -> DataFrame:
    """``RANK()`` (ties share the lowest rank) by ``value_col``; NULL values get a NULL
    rank.  Distributed equivalent of ``rank().over(Window.orderBy(v))``: the rows are
    written once (they are read for the cuts, the counts and the ranks) and shuffled
    once."""
    v = F.col(value_col)
    rows = cut_lineage(df, "ranked")
    ranged = _ranged(rows.filter(v.isNotNull()), value_col, ranges)
    on_cut = F.col("_r") % 2 == 1
    w = Window.partitionBy("_r", "_spread").orderBy(v.desc() if descending else v.asc())
    # rows on a cut are equal: any spreading of them over tasks will do
    spread = ranged.withColumn("_spread", F.when(on_cut, F.spark_partition_id()).otherwise(F.lit(-1)))
    ranked = spread.withColumn("_local", F.when(on_cut, F.lit(1)).otherwise(F.rank().over(w)))
    known = ranked.join(_offsets(ranged, F.count(F.lit(1)), descending), "_r").select(
        *df.columns, (F.col("_off") + F.col("_local")).cast("bigint").alias(rank_col))
    return known.unionByName(rows.filter(v.isNull()).withColumn(rank_col, F.lit(None).cast("bigint")))


def spearman(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """One row (spearman_rho): the correlation of the average ranks of two columns without
    nulls.  Equal pairs are counted first, so the ranks are joined to distinct pairs only
    and a hot value or pair is one row."""
    counted = cut_lineage(pairs.groupBy(x, y).agg(F.count(F.lit(1)).alias("_n")), "pairs")

    def average_rank(c: str) -> DataFrame:
        return value_positions(counted, c, weight="_n").select(c, (F.col("_before") + (F.col("_k") + 1) / 2.0).alias(f"_rank_{c}"))

    middle = counted.agg((F.sum("_n") + 1) / 2.0).scalar()
    ranked = counted.join(average_rank(x), x).join(average_rank(y), y).select(
        "_n", (F.col(f"_rank_{x}") - middle).alias("_a"), (F.col(f"_rank_{y}") - middle).alias("_b"))
    n, a, b = F.col("_n"), F.col("_a"), F.col("_b")
    return ranked.agg(F.try_divide(F.sum(n * a * b), F.sqrt(F.sum(n * a * a) * F.sum(n * b * b))).alias("spearman_rho"))
