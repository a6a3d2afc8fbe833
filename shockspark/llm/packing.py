"""Packing by optimal length buckets.

A document of more than ``context`` tokens is cut into windows of ``context`` (no token is
lost), so lengths are bounded whatever the documents.  The global histogram of lengths, in
steps of ``align``, has at most ``context / align`` rows (checked against ``MAX_BINS``);
only this histogram reaches the driver.  Dynamic programming over it chooses the bucket
boundaries with the least total padding for ``buckets`` buckets: the least padding of the
first j lengths in k buckets is the minimum over i < j of that of the first i lengths in
k - 1 buckets plus that of one bucket for the lengths i+1..j, all padded to the j-th.  Of
equal sums the smaller i is taken.

Every sequence is padded to its bucket's boundary, and a batch holds as many sequences of
one bucket as the token budget allows.  Numbering is global and exact without a global
sort: rows fall into ``16 ** SHARD_DIGITS`` shards by a hash of the row, are numbered inside
(bucket, shard), and the counts of the earlier shards are added, so at most one batch per
bucket is not full, and neither a hot bucket nor a long document gathers in one task.

Defined results: a null length counts as 0; a sequence of length 0 is a row of the first
bucket; repeated rows are packed each; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shockspark.llm.common import at, written

MAX_BINS = 65_536
SHARD_DIGITS = 3


def best_boundaries(bins: list[int], counts: list[int], tokens: list[int], buckets: int, align: int) -> list[int]:
    """Ascending bucket boundaries (in bins) of least padding; ``bins`` are ascending."""
    size = len(bins)
    if not size:
        return []
    n = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
    s = np.concatenate([[0], np.cumsum(np.array(tokens, np.int64))])
    top = np.array(bins, np.int64) * align
    least = np.full(size + 1, np.iinfo(np.int64).max // 4)
    least[0] = 0
    cuts = []
    for _ in range(min(buckets, size)):
        step, cut = np.full_like(least, np.iinfo(np.int64).max // 4), np.zeros(size + 1, np.int64)
        for j in range(1, size + 1):
            total = least[:j] + top[j - 1] * (n[j] - n[:j]) - (s[j] - s[:j])
            cut[j] = int(np.argmin(total))
            step[j] = total[cut[j]]
        least = step
        cuts.append(cut)
    ends, j = [], size
    for cut in reversed(cuts):
        ends.append(bins[j - 1])
        j = int(cut[j])
    return ends[::-1]


def windows(df: DataFrame, length: Column, key: str, context: int) -> DataFrame:
    """(key, part, start, length): the windows of every document."""
    whole = df.select(at(key), F.greatest(F.coalesce(length.cast("bigint"), F.lit(0)), F.lit(0)).alias("tokens"))
    parts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.ceil(F.col("tokens") / F.lit(context)) - 1).cast("bigint"))
    cut = whole.select(at(key), "tokens", F.explode(parts).alias("part")).withColumn("start", F.col("part") * context)
    return cut.select(at(key), "part", "start", F.least(F.col("tokens") - F.col("start"), F.lit(context)).alias("length"))


def pack(df: DataFrame, length: Column, key: str = "doc_id", context: int = 4096, align: int = 64, buckets: int = 8,
         budget: int = 65_536) -> DataFrame:
    """One row per sequence: key, part, start, length, bucket (the padded length), batch
    (0.. inside the bucket) and place (0.. inside the batch)."""
    if context % align or context // align > MAX_BINS or budget < context:
        raise ValueError("context must be a multiple of align, with at most MAX_BINS steps, and within the budget")
    spark = df.sparkSession
    shard = F.substring(F.md5(F.concat_ws("/", at(key).cast("string"), F.col("part"), F.col("length"))), 1, SHARD_DIGITS)
    rows = windows(df, length, key, context).withColumn("bin", F.greatest(F.lit(1), F.ceil(F.col("length") / align)).cast("int"))
    rows = written(rows.withColumn("shard", shard), "packing_rows")
    seen = sorted(rows.groupBy("bin").agg(F.count("*"), F.sum("length")).collect())  # at most context / align rows
    ends = best_boundaries(*([r[i] for r in seen] for i in range(3)), buckets, align)
    bucket = F.lit(context)
    for end in reversed(ends):
        bucket = F.when(F.col("bin") <= end, end * align).otherwise(bucket)
    rows = rows.withColumn("bucket", bucket.cast("bigint"))
    inside = Window.partitionBy("bucket", "shard").orderBy(at(key), "part", "length")
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("bucket", "shard").count().select(
        "bucket", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    # at most buckets * 16 ** SHARD_DIGITS rows
    numbered = rows.withColumn("nth", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["bucket", "shard"])
    rank, each = F.col("nth") + F.col("offset"), F.floor(F.lit(budget) / F.col("bucket"))
    return numbered.select(at(key), "part", "start", "length", "bucket",
                           F.floor(rank / each).cast("bigint").alias("batch"), (rank % each).cast("bigint").alias("place"))


def byte_length(text: str = "text") -> Column:
    """Tokens of a text under the byte alphabet of a byte-level tokenizer without merges;
    with a tokenizer, pass ``size(ids)`` instead."""
    return F.octet_length(at(text))
