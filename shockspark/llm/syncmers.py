"""Document fingerprints by closed syncmers, in DataFrame functions only.

The symbols of a text are its lower-cased words (runs without ASCII white space).  Of all
k-mers (k neighbouring words) those are chosen whose minimal s-mer, by hash, is the first
or the last one inside them.  The choice looks at the k-mer alone, so a k-mer is chosen in
every text it occurs in, whatever stands around it: an edit changes only the anchors that
overlap it.  The fingerprint is the sequence of the chosen k-mers' hashes in text order,
8 hex digits each; their word positions can be had, too.

Likeness of two fingerprints: twice the number of shared distinct anchors over the sum of
the distinct anchors (1 if both are empty).  It compares sets: order, positions and
repetitions do not count.

Defined results: a null or empty text has no anchors (an empty fingerprint); a text in
which no k-mer is chosen (fewer than k words, or few more) has one anchor, the hash of all
its words; equal texts have equal
fingerprints; an empty table gives an empty table; input columns that clash with output
names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shockspark.llm.common import at, fresh, text_or_empty, without
from shockspark.llm.ranges import deal

K, S = 5, 2
BLANKS = " \t\n\x0b\f\r"


def _picked(hashes: Column, smers: Column, k: int, s: int, value) -> Column:
    """``value(i)`` for every chosen k-mer, by its first word i."""
    last = F.size(hashes) - k

    def chosen(x, i):
        edge = F.least(x, F.get(smers, i + (k - s)))
        inner = [F.get(smers, i + t) for t in range(1, k - s)]
        if not inner:
            return value(i)
        return F.when(edge <= (F.least(*inner) if len(inner) > 1 else inner[0]), value(i))

    starts = F.slice(smers, F.lit(1), F.greatest(last + 1, F.lit(0)))
    return F.filter(F.transform(starts, chosen), lambda v: v.isNotNull())


def anchors(df: DataFrame, text: str = "text", out: str = "anchors", positions: str | None = None, k: int = K, s: int = S) -> DataFrame:
    """``df`` with the anchors of each whole text (array of int, in text order) as column
    ``out``, and the word positions of the k-mers as column ``positions`` if named."""
    if not 0 < s < k:
        raise ValueError("s must lie between 0 and k")
    h, m = fresh(df, "word_hashes"), fresh(df, "smer_hashes")
    cut = F.split(F.btrim(F.lower(text_or_empty(text)), F.lit(BLANKS)), r"[\x20\x09-\x0D]+")
    # two steps of their own: inside one expression each use would be worked out again
    hashed = df.withColumn(h, F.transform(F.filter(cut, lambda w: w != ""), lambda w: F.xxhash64(w)))
    hashed = hashed.withColumn(m, F.transform(at(h), lambda x, i: F.xxhash64(x, *[F.get(at(h), i + t) for t in range(1, s)])))
    whole = F.when(F.size(at(h)) > 0, F.array(F.shiftright(F.aggregate(at(h), F.lit(0).cast("bigint"), lambda a, x: F.xxhash64(a, x)), 32).cast("int"))).otherwise(
        F.array().cast("array<int>"))
    kmer = _picked(at(h), at(m), k, s, lambda i: F.shiftright(F.xxhash64(*[F.get(at(h), i + t) for t in range(k)]), 32).cast("int"))
    c = fresh(df, "chosen_kmers")
    hashed = hashed.withColumn(c, kmer)
    none = F.size(at(c)) == 0
    found = {out: F.when(none, whole).otherwise(at(c))}
    if positions:
        found[positions] = F.when(none, F.transform(whole, lambda _: F.lit(0))).otherwise(_picked(at(h), at(m), k, s, lambda i: i))
    return hashed.select(*[at(x) for x in without(df, *found).columns], *[x.alias(name) for name, x in found.items()])


def as_text(marks: Column) -> Column:
    """The fingerprint string of an anchor column."""
    return F.array_join(F.transform(marks, lambda a: F.lpad(F.lower(F.hex(a.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of distinct anchors that two anchor columns have in common (0 to 1)."""
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "next_text") -> DataFrame:
    """``df`` with the text of the next row in descending order of the whole-number column
    ``key`` (nulls last, rows of one key by a hash of their text; after the last row comes
    the first) as ``out``.  Each text is shuffled once, to the range of its key."""
    order = fresh(df, "key_order")
    # 16 hexadecimal digits that sort as the key descends
    falling = F.lpad(F.hex(at(key).cast("bigint").bitwiseXOR(F.lit(2 ** 63 - 1))), 16, "0")
    sortable = F.concat_ws("-", F.coalesce(falling, F.lit("null")), F.hex(F.xxhash64(text_or_empty(text))))
    dealt, part, side = deal(df.withColumn(order, sortable), order, text)
    w = Window.partitionBy(at(part)).orderBy(at(side), at(order))
    return dealt.withColumn(out, F.lead(text_or_empty(text)).over(w)).filter(at(side) == 0).select(*[at(c) for c in without(df, out).columns], at(out))


def replace_tail(text: Column, by: Column) -> Column:
    """``text`` with its last third (floor, in code points) replaced by the first as many
    code points of ``by``, or all of them."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.left(text, F.char_length(text) - third), F.left(by, third))
