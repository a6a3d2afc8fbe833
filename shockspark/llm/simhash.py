"""SimHash near-duplicates by deletion-variant signatures.

Fingerprint: A-Z are lower-cased, words are runs without ASCII white space, shingles are
``shingle`` words joined by a blank, repeats included (fewer words: the whole sequence;
none: fingerprint zero).  A bit is set when it is set in more than half of the shingles'
XXH64 values.

Search: with at most ``d`` differing bits, the 64 bits are cut into ``d // 2 + 1``
segments, so that one of them differs by at most one bit.  Every distinct fingerprint is
indexed under each segment as it is and under each segment with one bit as a wildcard.
What the wildcard leaves open of the distance must hold in the other bits, so these are
cut into one piece more than may differ and the key takes in one piece: equal keys then
agree in about 3/4 of the bits, which keeps the candidates near the links however many
fingerprints there are.  Under a wildcard only a 0 meets a 1, so a pair is not met again
under every wildcard of an equal segment.  With ``d`` even the last segment needs no
wildcards: if all earlier segments differ by two bits, it is equal.

Candidates are joined by key between distinct fingerprints (copies are one row of the
index), verified by their bit distance, and joined into components.

Defined results: null and empty texts have fingerprint zero and are linked like any
other; equal texts share a component; ids may repeat or be null (a component's id is its
least id that is not null); an empty table gives an empty table; input columns that clash
with output names are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockspark.llm.common import at, fresh, ship, text_or_empty, without, written
from shockspark.llm.graph import components

SEED = 42
BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
PLACES = 256 * np.arange(8)


def simhash(text: str, shingle: int = 3) -> int:
    """The fingerprint of one text as an unsigned integer."""
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle))))) or [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), "<u8", len(grams))
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + PLACES).ravel(), minlength=2048)
    ones = (counts.reshape(8, 256) @ BITS_OF).ravel()
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = 3, out: str = "simhash") -> DataFrame:
    """``df`` with the fingerprint of each whole text as a bigint column ``out``."""
    ship(df.sparkSession)

    def hashed(texts: pa.Array) -> pa.Array:
        found = np.fromiter((simhash(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64), pa.int64())

    own = fresh(df, "text_simhash")
    found = df.withColumn(own, F.arrow_udf(hashed, "bigint")(text_or_empty(text)))
    return found.select(*[at(c) for c in without(df, out).columns], at(own).alias(out))


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def _cuts(bits: list[int], parts: int) -> list[list[int]]:
    """Consecutive runs of about equal length."""
    ends = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(ends, ends[1:]) if a < b]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def _index(prints: DataFrame, distance: int, side: int) -> DataFrame:
    """(key, f) rows of the variants that one side of the join looks up: exact segments on
    both sides, a wildcard bit of 0 on side 0 and of 1 on side 1."""
    f, bits = F.col("f"), list(range(64))
    segments = _cuts(bits, distance // 2 + 1)
    keys, tag = [], 0
    for n, near in enumerate(segments):
        far = [b for b in bits if b not in near]
        for piece in _cuts(far, distance + 1) or [[]]:
            keys.append(F.xxhash64(F.lit(tag), f.bitwiseAND(F.lit(_mask(near + piece)))))
            tag += 1
        if n == len(segments) - 1 and distance % 2 == 0:
            continue
        for wild in near:
            rest = [b for b in near if b != wild]
            for piece in _cuts(far, distance) or [[]]:
                hit = F.getbit(f, F.lit(wild)) == side
                keys.append(F.when(hit, F.xxhash64(F.lit(tag), f.bitwiseAND(F.lit(_mask(rest + piece))))))
                tag += 1
    return prints.select(F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("key"), f)


def linked(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b), a < b, of distinct fingerprints (column f) at ``distance`` bits or
    less, each once."""
    if not 0 < distance < 8:
        raise ValueError("distances of 1 to 7 bits are supported")
    a = _index(prints, distance, 0).withColumnRenamed("f", "a")
    b = _index(prints, distance, 1).withColumnRenamed("f", "b")
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return a.join(b, "key").filter(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(prints: DataFrame, distance: int = 2) -> DataFrame:
    """(f, root): the component of every fingerprint of ``prints`` (column f, repeats
    allowed); root is the component's least fingerprint."""
    distinct = written(prints.select("f").distinct(), "simhash_prints")
    roots = components(linked(distinct, distance)).withColumnRenamed("node", "f")
    return distinct.join(roots, "f", "left").select("f", F.coalesce("root", "f").alias("root"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2,
                    keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``df`` (default: all but the text) with fingerprint (16 hex
    digits) and component_id, the least ``key`` in the document's component."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    base = without(df.select(*[at(c) for c in dict.fromkeys([*keep, key, text])]), "fingerprint", "component_id")
    f = fresh(base, "f")
    rows = written(fingerprints(base, text, shingle, out=f).select(*[at(c) for c in base.columns if c != text or c in keep], at(f)), "simhash_rows")
    first = rows.groupBy(at(f).alias("f")).agg(F.min(at(key)).alias("first"))
    members = written(classes(rows.select(at(f).alias("f")), distance).join(first, "f"), "simhash_members")
    least = members.groupBy("root").agg(F.min("first").alias("component_id"))
    named = members.join(least, "root").select(F.col("f").alias(f), "component_id")
    return rows.join(named, f).select(*[at(c) for c in keep if c in base.columns], as_hex(at(f)).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``df`` less all but one of each component: the row with the least key
    stays (a null key only where the component has no other; of repeated rows, one)."""
    f, n = fresh(df, "f"), fresh(df, "row_number")
    rows = written(fingerprints(df, text, shingle, out=f).withColumn(n, F.monotonically_increasing_id()), "simhash_rows")
    best = F.min(F.struct(at(key).isNull().alias("unknown"), at(key).alias("key"), at(n).alias("row"))).alias("best")
    first = rows.groupBy(at(f).alias("f")).agg(best)
    roots = classes(rows.select(at(f).alias("f")), distance)
    stay = roots.join(first, "f").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(n))
    return rows.join(stay, n, "left_semi").select(*[at(c) for c in df.columns])
