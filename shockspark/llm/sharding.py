"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: start at an
offset and step by a skip, both hashes of the shard's name.  The shards take turns; on its
turn a shard claims the next slot of its order that is still free, until the table is
full.  A row goes to slot ``hash(key) mod size``, so placement is one look-up, the shards'
shares differ by at most one slot, and adding or removing a shard moves few keys.

The table is built on the driver (``size`` entries, checked against ``MAX_SLOTS``) and
reaches the executors as one broadcast look-up table; rows are placed by a join on the
slot without a shuffle, so no hot key gathers anywhere.

Null keys are one key of their own (they share a slot); equal keys share a shard; an empty
table gives an empty table; columns of the input that clash with output names are
replaced.
"""

from __future__ import annotations

import hashlib
from itertools import cycle

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockspark.llm.common import at, fresh, without

#: The look-up table is broadcast; it may not be larger than this.
MAX_SLOTS = 1_000_003
SLOTS = 8191


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def lookup_table(shards: list[str], size: int = SLOTS) -> list[int]:
    """The shard index of every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    if not _is_prime(size) or not len(shards) <= size <= MAX_SLOTS:
        raise ValueError("the table size must be a prime between the number of shards and MAX_SLOTS")
    place = [_number(f"{s}/offset") % size for s in shards]
    skip = [_number(f"{s}/skip") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    free = size
    for i in cycle(range(len(shards))):
        while owner[place[i]] >= 0:
            place[i] = (place[i] + skip[i]) % size
        owner[place[i]] = i
        free -= 1
        if not free:
            return owner


def slot_of(key: Column, size: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of its MD5 modulo the table size."""
    digest = F.md5(F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("")))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(size)).cast("int")


def assign_shards(df: DataFrame, shards: list[str], key: str = "doc_id", size: int = SLOTS) -> DataFrame:
    """``df`` with columns slot and shard."""
    spark = df.sparkSession
    owner = lookup_table(shards, size)
    slot, shard = fresh(df, "slot_number"), fresh(df, "shard_index")
    table = spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, owner))), ",")).alias(slot, shard))
    names = F.array(*map(F.lit, shards))
    placed = df.withColumn(slot, slot_of(at(key), size)).join(F.broadcast(table), slot, "left")
    return placed.select(*[at(c) for c in without(df, "slot", "shard").columns], at(slot).alias("slot"),
                         F.element_at(names, at(shard).cast("int") + 1).alias("shard"))
