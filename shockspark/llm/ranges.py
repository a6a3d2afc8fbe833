"""Neighbours in a global order without a global window.

Rows are dealt to ranges of a key; a bounded number of range bounds, and of the rows that
stand at the ends of ranges, are held.  An end row is also dealt, as a guest, to the range
beside it, so the neighbours of every row are found inside its own range.  Which bounds
are drawn changes the dealing only, not the neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockspark.llm.common import at, fresh

MAX_RANGES = 4096
KEYS_PER_RANGE = 20


def range_of(value: Column, bounds: list) -> Column:
    """Number of bounds at or below the value, by binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    size = 1 << len(bounds).bit_length()
    held = F.array(*map(F.lit, bounds))
    halves = F.array(*[F.lit(size >> i) for i in range(1, size.bit_length())])
    return F.aggregate(halves, F.lit(0), lambda low, half: F.when(
        F.coalesce(F.get(held, low + half - 1) <= value, F.lit(False)), low + half).otherwise(low))


def deal(df: DataFrame, order: str, payload: str, rows_per_range: int = 250) -> tuple[DataFrame, str, str]:
    """``df`` hash-partitioned by range of the text or number column ``order``, with the
    guests; returns it with the names of the added columns: the range and the side (0: a
    row of its own, -1 and 1: a guest from the range before or after, which has values
    in ``order`` and ``payload`` only).  After the last range comes the first and the other
    way round (a guest that wrapped keeps its side)."""
    part, side = fresh(df, "key_range"), fresh(df, "guest_side")
    count = df.count()
    ranges = max(1, min(MAX_RANGES, count // rows_per_range))
    bounds = []
    if ranges > 1:
        # every n-th key by hash, about KEYS_PER_RANGE * MAX_RANGES at most, to place the bounds
        every = max(1, count // (ranges * KEYS_PER_RANGE))
        keys = df.select(at(order).alias("k")).filter(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).distinct()
        drawn = sorted(r.k for r in keys.collect() if r.k is not None)
        bounds = sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)} if drawn else ())
    keyed = df.withColumn(part, range_of(at(order), bounds))
    ends = sorted(keyed.groupBy(at(part).alias("r")).agg(F.min(at(order)).alias("a"), F.max(at(order)).alias("b")).collect())
    guests = []
    for i, (_, a, b) in enumerate(ends):
        guests.append((a, ends[i - 1][0], 1))
        guests.append((b, ends[(i + 1) % len(ends)][0], -1))
    own = keyed.withColumn(side, F.lit(0))
    if guests:
        marks = df.sparkSession.range(1).select(F.inline(F.array(*[
            F.struct(F.lit(k).alias("k"), F.lit(to).alias("to"), F.lit(s).alias("s")) for k, to, s in guests])))
        met = df.select(at(order).alias("k"), at(payload).alias("v")).join(F.broadcast(marks), "k").groupBy("k", "to", "s").agg(F.first("v").alias("v"))
        values = {order: F.col("k"), payload: F.col("v")}
        fields = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema.fields]
        own = own.unionByName(met.select(*fields, F.col("to").alias(part), F.col("s").alias(side)))
    return own.repartition(at(part)), part, side
