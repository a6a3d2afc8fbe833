"""Hard-negative mining: for every anchor and each of its best positives, the best rows of
another label whose score lies in a window below the positive's.

Candidates are ordered by label and, within a label, along a Hilbert curve through the
vectors, and written as Parquet rows of up to ``GROUP_BYTES`` of vectors.  Every group
carries a zone map: the least and greatest value of each dimension, and of the label, for
each block of ``BLOCK`` candidates.  A search deals with windows (anchor, label rule, least
and greatest score).  Interval arithmetic on a zone bounds the scores of an anchor with all
rows of a block; a group that no window of a batch of anchors can reach is not read by that
batch, and within a group only the blocks that a window can reach are scored.  Each search
reads the most promising group of every batch first: the k-th best score found there lifts
the windows' lower ends, and the bounds are taken again before the rest is read.

Results are exact whatever the bounds leave out: scores are inner products of whole numbers,
taken in float32 or float64 while every partial sum is a whole number there, and else
in Python's integers.  How much is left out depends on the data (README).

Rows without an id, a label or a vector, and those with a null or non-finite component
(also after scaling), take no part.  Vectors of different lengths are not compared; those
of no component score 0.  Ties go to the smaller id.  Repeated rows count as rows, but equal
anchor rows are one anchor, and a row that bears the anchor's id is none of its partners.
Rows whose score with an anchor a long cannot hold are none of its partners.  An empty table
gives no row.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shockspark.functions.broadcast import bounded_broadcast
from shockspark.llm.common import at, ship, written

BLOCK = 256  # candidates of a zone
GROUP_BYTES = 8 << 20  # of vectors in a group, at 8 bytes a component
MOST_ROWS = 1 << 15  # of a group
ANCHORS = 1024  # of a batch
KEY_BYTES = 32  # of the curve's position that order the candidates
LEVELS = 2  # halvings of each dimension
LEAST, MOST = -(1 << 63), (1 << 63) - 1

GROUPS = "group long, dim int, ids binary, labels binary, vectors binary, wide boolean, low binary, high binary, least_label binary, most_label binary"
ZONE = ["group", "dim", "low", "high", "least_label", "most_label"]
BATCHES = "batch long, dim int, ids binary, labels binary, vectors binary, name array<int>, of array<int>, least array<long>, most array<long>"


# vectors ------------------------------------------------------------------------------

def scaled(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component as whole doubles; null if a component is null or
    not finite, before or after scaling."""
    grown = F.transform(vector.cast("array<double>"), lambda x: x * scale)
    whole = F.transform(grown, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    fine = F.forall(grown, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, whole)


def hilbert(points: np.ndarray, centre: float, spread: float, levels: int = LEVELS) -> np.ndarray:
    """The position of each point (a row) on a Hilbert curve through the cube of ``centre``
    +- two ``spread``, as rows of bytes in order of significance (the transpose form of
    the curve's index: rotations undone from the finest level up, then Gray-coded)."""
    n, cells = points.shape[1], 1 << levels
    place = np.clip((points - centre) / (4 * spread or 1) * cells + cells / 2, 0, cells - 1).astype(np.int64).T.copy()
    bit = cells >> 1
    while bit > 1:
        rest = bit - 1
        for i in range(n):
            set_ = (place[i] & bit) > 0
            swap = np.where(set_, 0, (place[0] ^ place[i]) & rest)
            place[0] ^= np.where(set_, rest, swap)
            place[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        place[i] ^= place[i - 1]
    turn, bit = np.zeros_like(place[-1]), cells >> 1
    while bit > 1:
        turn ^= np.where((place[-1] & bit) > 0, bit - 1, 0)
        bit >>= 1
    place ^= turn
    bits = ((place[None] >> np.arange(levels - 1, -1, -1)[:, None, None]) & 1).reshape(levels * n, -1)
    return np.packbits(bits.astype(np.uint8).T, axis=1)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, end to end, and the offsets of its rows."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]], offsets - offsets[0]


def _keys(centre: float, spread: float):
    def keys(vectors: pa.Array) -> pa.Array:
        values, ends = _lists(vectors)
        size, out = np.diff(ends), [b""] * len(vectors)
        for n in np.unique(size[size > 0]):
            rows = np.flatnonzero(size == n)
            points = values[ends[rows][:, None] + np.arange(n)]
            for i, key in zip(rows, hilbert(points, centre, spread)[:, :KEY_BYTES]):
                out[i] = key.tobytes()
        return pa.array(out, pa.binary())

    return keys


def ordered(df: DataFrame, anchor: Column, vec_id: str, vector: str, label: str, scale: float) -> DataFrame:
    """(dim, label, key, id, q, anchor) of the rows that take part, written: ``key`` is the
    place on the curve."""
    ship(df.sparkSession)
    rows = df.select(at(vec_id).cast("long").alias("id"), at(label).cast("long").alias("label"), scaled(at(vector), scale).alias("q"),
                     F.coalesce(anchor, F.lit(False)).alias("anchor")).filter("id is not null and label is not null and q is not null")
    total = lambda f: F.aggregate("q", F.lit(0.0), lambda s, x: s + f(x))
    n, s, s2 = rows.agg(F.sum(F.size("q")), F.sum(total(lambda x: x)), F.sum(total(lambda x: x * x))).first()
    centre = s / n if n else 0.0
    spread = max(s2 / n - centre * centre, 0.0) ** 0.5 if n else 0.0
    if not np.isfinite(spread) or not np.isfinite(centre):
        centre, spread = 0.0, 1.0
    keyed = rows.withColumn("key", F.arrow_udf(_keys(centre, spread), "binary")("q"))
    return written(keyed.select(F.size("q").alias("dim"), "label", "key", "id", "q", "anchor"), "vectors")


def _sorted(rows: DataFrame) -> DataFrame:
    order = ["dim", "label", "key", "id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def _runs(batches: Iterator[pa.RecordBatch], most) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dim, ids, labels, vectors) of consecutive rows of one length, ``most(dim)`` at most."""
    held: list[tuple] = []

    def joined():
        return held[0][0], *(np.concatenate([h[i] for h in held]) for i in (1, 2, 3))

    for batch in batches:
        dims = batch.column("dim").to_numpy()
        ids, labels = (batch.column(c).to_numpy() for c in ("id", "label"))
        values, ends = _lists(batch.column("q"))
        start = 0
        while start < len(dims):
            dim = int(dims[start])
            if held and held[0][0] != dim:
                yield joined()
                held = []
            room = most(dim) - sum(len(h[1]) for h in held)
            stop = start + int(np.argmax(np.append(dims[start:start + room] != dim, True)))
            held.append((dim, ids[start:stop], labels[start:stop], values[ends[start]:ends[stop]].reshape(stop - start, dim)))
            if stop - start == room:
                yield joined()
                held = []
            start = stop
    if held:
        yield joined()


def _numbered() -> Iterator[int]:
    """Numbers that no other task uses."""
    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    while True:
        yield first
        first += 1


def _bytes(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def zone_map(labels: np.ndarray, vectors: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """Least and greatest component by block and dimension, and the same of the labels."""
    starts = np.arange(0, len(labels), block)
    return tuple(f.reduceat(x, starts, axis=0) for x in (vectors, labels) for f in (np.minimum, np.maximum))


def candidate_groups(rows: DataFrame, block: int = BLOCK, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The candidates of ``ordered`` as groups with their zone maps, written."""
    schema = GROUPS

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        most = lambda dim: min(MOST_ROWS, max(block, group_bytes // (8 * dim or 1)))
        for number, (dim, ids, labels, q) in zip(_numbered(), _runs(batches, most)):
            low, high, least, greatest = zone_map(labels, q, block)
            wide = bool(q.size and np.abs(q).max() >= 1 << 24)
            row = [number, dim, *_bytes(ids, labels, q if wide else q.astype(np.float32)), wide, *_bytes(low, high, least, greatest)]
            yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, row)}, schema=_arrow(schema))

    return written(_sorted(rows.drop("anchor")).mapInArrow(packed, schema), "groups")


def anchor_batches(rows: DataFrame, size: int = ANCHORS) -> DataFrame:
    """The anchors in batches of neighbours on the curve, with one open window each."""
    schema = BATCHES

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for number, (dim, ids, labels, q) in zip(_numbered(), _runs(batches, lambda _: size)):
            each = np.arange(len(ids), dtype=np.int32)
            row = [number, dim, *_bytes(ids, labels, q), each, each, np.full(len(ids), LEAST), np.full(len(ids), MOST)]
            yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(names, row)}, schema=_arrow(schema))

    return written(_sorted(rows.filter("anchor").drop("anchor").distinct()).mapInArrow(packed, schema), "anchors")


_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64(),
          "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in schema.split(", "))])


# bounds -------------------------------------------------------------------------------

def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that an anchor (row) can have with a vector of a zone (column)."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    size = np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T
    slack = np.where(size < 2.0**53, 0, size * 1e-9)  # beyond, the sums above are rounded
    return least - slack, most + slack


class Batch:
    """Anchors and their windows."""

    def __init__(self, row: dict):
        self.dim = row["dim"]
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(self.ids), self.dim)
        self.name, self.of, self.least, self.most = (np.array(row[c], np.int64) for c in ("name", "of", "least", "most"))

    def reach(self, zones: dict, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Which window (row) can hold a score of which block (column), and the greatest
        scores of anchors with blocks."""
        first, last = (np.frombuffer(zones[c], np.int64) for c in ("least_label", "most_label"))
        low, high = (np.frombuffer(zones[c], np.float64).reshape(len(first), self.dim) for c in ("low", "high"))
        least, most = bounds(self.vectors, low, high)
        own = self.labels[:, None]
        asked = (first <= own) & (own <= last) if same else (first != own) | (last != own)
        most = np.where(asked, most, -np.inf)
        return asked[self.of] & (most[self.of] >= self.least[:, None]) & (least[self.of] <= self.most[:, None]), most


def reading(groups: DataFrame, batches: DataFrame, same: bool) -> DataFrame:
    """(group, batch, wanted, blocks, best), one row for each group that a window of the
    batch can reach: of its ``blocks`` so many are ``wanted``; ``best`` is the mean of the
    anchors' greatest bounds.  Zones go to every batch (rows / BLOCK of them), vectors do
    not."""
    lots = bounded_broadcast(batches.select("batch", "dim"))
    pairs = groups.select(*ZONE).join(lots, "dim").drop("dim").join(batches, "batch")
    schema = "group long, batch long, wanted int, blocks int, best double"

    def judged(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in found:
            out = []
            for row in part.to_pylist():
                need, most = Batch(row).reach(row, same)
                if need.any():
                    top = most.max(axis=1)
                    out.append((row["group"], row["batch"], int(need.any(axis=0).sum()), need.shape[1], float(np.nan_to_num(top, neginf=-1e300).mean())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, _arrow(schema).types)], schema=_arrow(schema))

    return written(pairs.mapInArrow(judged, schema), "reading")


# scores -------------------------------------------------------------------------------

def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the whole-numbered rows of ``a`` and ``b``, exact, as int64; those
    beyond a long become its least or greatest value."""
    if not a.shape[1] or not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    largest = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if largest < 1 << 53:
        kind = np.float32 if largest < 1 << 24 else np.float64
        return (a.astype(kind, copy=False) @ b.astype(kind, copy=False).T).astype(np.int64)
    exact = np.frompyfunc(int, 1, 1)
    return np.clip(exact(a) @ exact(b.astype(np.float64)).T, LEAST, MOST).astype(np.int64)


def best_of_group(batch: Batch, group: dict, same: bool, k: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, score, id) of the k best rows of a group in each window, of blocks that it
    can reach.  Once k are found, the k-th score is the window's lower end."""
    need, most = batch.reach(group, same)
    ids, labels = (np.frombuffer(group[c], np.int64) for c in ("ids", "labels"))
    vectors = np.frombuffer(group["vectors"], np.float64 if group["wide"] else np.float32).reshape(len(ids), batch.dim)
    windows = len(batch.of)
    scores, names, count = np.full((windows, k), LEAST), np.zeros((windows, k), np.int64), np.zeros(windows, np.int64)
    least, wanted = batch.least.copy(), np.flatnonzero(need.any(axis=0))
    for b in wanted[np.argsort(-most[:, wanted].max(axis=0), kind="stable")]:
        asking = np.flatnonzero(need[:, b] & (most[batch.of, b] >= least))
        if not asking.size:
            continue
        anchors, row = np.unique(batch.of[asking], return_inverse=True)
        rows = slice(b * block, (b + 1) * block)
        found = products(batch.vectors[anchors], vectors[rows])
        fits = (labels[rows] == batch.labels[anchors][:, None]) == same
        fits &= (ids[rows] != batch.ids[anchors][:, None]) & (found > LEAST) & (found < MOST)
        score = found[row]
        hit, column = np.nonzero(fits[row] & (score >= least[asking][:, None]) & (score <= batch.most[asking][:, None]))
        if not hit.size:
            continue
        met = np.unique(asking[hit])  # windows with news: merged with what they held
        kept = np.arange(k) < count[met][:, None]
        w = np.concatenate([asking[hit], np.repeat(met, k)[kept.ravel()]])
        s = np.concatenate([score[hit, column], scores[met][kept]])
        i = np.concatenate([ids[rows][column], names[met][kept]])
        order = np.lexsort((i, -s, w))
        w, s, i = w[order], s[order], i[order]
        starts = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        nth = np.arange(len(w)) - np.repeat(starts, np.diff(np.append(starts, len(w))))
        top = nth < k
        scores[w[top], nth[top]], names[w[top], nth[top]] = s[top], i[top]
        count[w[starts]] = np.minimum(np.diff(np.append(starts, len(w))), k)
        full = met[count[met] == k]
        least[full] = np.maximum(least[full], scores[full, k - 1])
    held = np.arange(k) < count[:, None]
    return np.repeat(np.arange(windows), k)[held.ravel()], scores[held], names[held]


FOUND = "batch long, name int, anchor_id long, score long, id long"


def _scan(groups: DataFrame, batches: DataFrame, pairs: DataFrame, same: bool, k: int, block: int) -> DataFrame:
    """The k best of each window in every pair of group and batch."""
    named = groups.select("group", F.struct(*groups.columns).alias("g"))
    met = pairs.select("group", "batch").join(batches, "batch").join(named, "group").drop("group")

    def scored(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in found:
            for i in range(part.num_rows):  # one pair at a time: a group is large
                row = part.slice(i, 1).to_pylist()[0]
                batch = Batch(row)
                w, score, ids = best_of_group(batch, row["g"], same, k, block)
                columns = [np.full(len(w), row["batch"]), batch.name[w], batch.ids[batch.of[w]], score, ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _arrow(FOUND).types)], schema=_arrow(FOUND))

    return met.mapInArrow(scored, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("batch", "name").orderBy(F.desc("score"), "id")
    return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k)


def _lifted(batches: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Windows that hold k scores begin at the k-th."""
    ends = found.filter(F.col("nth") == k).groupBy("batch").agg(F.map_from_entries(F.collect_list(F.struct("name", "score"))).alias("kth"))
    raised = F.transform(F.arrays_zip("name", "least"), lambda x: F.greatest(x["least"], F.try_element_at("kth", x["name"])))
    return written(batches.join(ends, "batch", "left").withColumn("least", F.when(F.col("kth").isNull(), F.col("least")).otherwise(raised)).drop("kth"), "windows")


def search(groups: DataFrame, batches: DataFrame, same: bool, k: int, block: int = BLOCK) -> DataFrame:
    """(batch, name, anchor_id, score, id, nth): the k best candidates of each window, of
    the anchor's label or (not ``same``) of others."""
    first = reading(groups, batches, same).groupBy("batch").agg(F.max_by("group", F.struct("best", "group")).alias("group"))
    first = written(first, "first")
    seeds = written(_best(_scan(groups, batches, first, same, k, block), k), "seeds")
    batches = _lifted(batches, seeds, k)
    rest = reading(groups, batches, same).join(first, ["group", "batch"], "left_anti")
    found = _scan(groups, batches, rest, same, k, block)
    return written(_best(seeds.drop("nth").unionByName(found), k), "found")


def windows_below(batches: DataFrame, positives: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """``batches`` with a window for each positive: low * score <= 100 * x <= high * score."""
    share = lambda percent, name: F.expr(f"cast(score as decimal(20)) * {percent}").alias(name)
    each = positives.withColumns({"a": share(low, "a"), "b": share(high, "b")}).select("batch", F.struct(
        (F.col("name") * k + F.col("nth") - 1).cast("int").alias("name"), F.col("name").alias("of"),
        F.expr("(a + pmod(-a, 100)) div 100").alias("least"), F.expr("(b - pmod(b, 100)) div 100").alias("most")).alias("w"))
    lists = each.groupBy("batch").agg(F.array_sort(F.collect_list("w")).alias("w"))  # k of each anchor of a batch
    kept = batches.drop("name", "of", "least", "most").join(lists, "batch")
    return written(kept.select("batch", "dim", "ids", "labels", "vectors", *[F.col("w")[c].alias(c) for c in ("name", "of", "least", "most")]), "windows")


def mine(df: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5,
         negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, block: int = BLOCK, group_bytes: int = GROUP_BYTES,
         anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each
    row where ``anchor`` holds, and each of its ``positives`` best rows of its label, the
    ``negatives`` best rows of other labels with a score of ``low`` to ``high`` percent of the
    positive's."""
    rows = ordered(df, anchor, vec_id, vector, label, scale)
    groups, batches = candidate_groups(rows, block, group_bytes), anchor_batches(rows, anchors)
    near = search(groups, batches, True, positives, block)
    below = windows_below(batches, near, positives, low, high)
    found = search(groups, below, False, negatives, block)
    pairs = near.select("batch", (F.col("name") * positives + F.col("nth") - 1).cast("int").alias("name"), F.col("id").alias("positive_id"),
                        F.col("score").alias("positive_score"))
    return found.join(pairs, ["batch", "name"]).select("anchor_id", "positive_id", F.col("nth").alias("rank"), F.col("id").alias("negative_id"),
                                                       "positive_score", F.col("score").alias("negative_score"))
