"""Byte-level BPE encoding and decoding.

A piece of text (one match of the split pattern) starts as its bytes.  A segment tree over
the byte positions holds, at each leaf, the rank of the pair that starts there (infinite
for dead positions and unknown pairs) together with the position, so the root is the
leftmost pair of minimum rank.  A merge changes three leaves - the merged position, its
dead right neighbour and the pair that starts at its live left neighbour - and each change
climbs the tree in logarithmic time.

Pieces of up to ``WIDE`` bytes are merged many at a time: the trees of a batch of pieces
are the rows of one array and every step is a vector operation over the rows that still
have a pair to merge.  Longer pieces get a tree of their own, so a piece of n bytes costs
O(n log n) however long it is.

Workers keep a bounded memory of pieces they have merged (``MEMORY`` entries, forgotten
when full); results do not depend on it.  The rank file is read on the driver and
broadcast (a fixed vocabulary, checked against ``MAX_RANKS``).

Defined results: a null or empty text has no ids; null ids decode to empty bytes; an id
that is not in the vocabulary is an error; equal texts get equal ids.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shockspark.llm.common import at, fresh, ship, text_or_empty, without

MAX_RANKS = 1_000_000
MEMORY = 150_000
WIDE = 32
CHUNK_CHARS = 1_000_000
INF = np.int64(1) << 62
SHIFT = 21  # of the left id in a pair's key; ids are below 2 ** SHIFT


class Vocabulary:
    """Ranks of byte strings, and the pairs of ids that merge."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines()) if token}
        if len(self.ranks) > MAX_RANKS:
            raise ValueError(f"{len(self.ranks)} ranks; a broadcast vocabulary takes at most {MAX_RANKS}")
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << SHIFT | right] = rank
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.merged = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, -1 if the pair does not merge."""
        want = left << SHIFT | right
        at_key = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at_key] == want, self.merged[at_key], -1)


def merge_one(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """Ids of one piece, by a segment tree of its own."""
    n = len(piece)
    ids = [int(vocabulary.byte_ids[b]) for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = vocabulary.pairs
    size = 1 << max(0, (n - 1).bit_length())
    none = int(INF)
    tree = [none] * (2 * size)

    def leaf(i: int) -> int:
        j = after[i]
        rank = pairs.get(ids[i] << SHIFT | ids[j]) if j < n else None
        return none if rank is None else rank << 32 | i

    def climb(i: int) -> None:
        i = size + i >> 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low
            i >>= 1

    for i in range(n):
        tree[size + i] = leaf(i)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    while (root := tree[1]) < none:
        i, rank = root & 0xFFFFFFFF, root >> 32
        j = after[i]
        ids[i], after[i] = rank, after[j]
        if after[j] < n:
            before[after[j]] = i
        tree[size + j] = none
        climb(j)
        tree[size + i] = leaf(i)
        climb(i)
        if before[i] >= 0:
            tree[size + before[i]] = leaf(before[i])
            climb(before[i])
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


def merge_many(vocabulary: Vocabulary, pieces: list[bytes], size: int) -> list[bytes]:
    """Ids (packed as int32) of pieces of 2 to ``size`` bytes, ``size`` a power of two; row
    r of every array belongs to piece r."""
    count = len(pieces)
    length = np.fromiter(map(len, pieces), np.int64, count)
    data = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(count, size)
    ids = np.zeros((count, size + 1), np.int64)
    ids[:, :size] = vocabulary.byte_ids[data]
    after = np.tile(np.arange(1, size + 2), (count, 1))
    before = np.tile(np.arange(-1, size), (count, 1))
    spot = np.arange(size)
    tree = np.full((count, 2 * size), INF)
    rank = vocabulary.pair_ranks(ids[:, :-1], ids[:, 1:])
    tree[:, size:] = np.where((rank >= 0) & (spot + 1 < length[:, None]), rank << 32 | spot, INF)
    for level in range(size.bit_length() - 2, -1, -1):
        low = 1 << level
        tree[:, low:2 * low] = np.minimum(tree[:, 2 * low:4 * low:2], tree[:, 2 * low + 1:4 * low:2])
    rows = np.arange(count)

    def put(r: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
        i = i + size
        tree[r, i] = value
        for _ in range(size.bit_length() - 1):
            i = i >> 1
            tree[r, i] = np.minimum(tree[r, 2 * i], tree[r, 2 * i + 1])

    while len(rows := rows[tree[rows, 1] < INF]):
        root = tree[rows, 1]
        i, new = root & 0xFFFFFFFF, root >> 32
        j = after[rows, i]
        k = after[rows, j]
        ids[rows, i] = new
        after[rows, i] = k
        before[rows, k] = i
        put(rows, j, np.full(len(rows), INF))
        right = vocabulary.pair_ranks(new, ids[rows, k])
        put(rows, i, np.where((k < length[rows]) & (right >= 0), right << 32 | i, INF))
        h = before[rows, i]
        some = h >= 0
        r, h = rows[some], h[some]
        left = vocabulary.pair_ranks(ids[r, h], new[some])
        put(r, h, np.where(left >= 0, left << 32 | h, INF))
    live = np.zeros((count, size), bool)
    spots = np.zeros(count, np.int64)
    rows = np.arange(count)
    while len(rows := rows[spots[rows] < length[rows]]):
        live[rows, spots[rows]] = True
        spots[rows] = after[rows, spots[rows]]
    flat = ids[:, :size][live].astype("<i4").tobytes()
    ends = 4 * np.cumsum(live.sum(1))
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Encoder:
    """Encodes texts in a worker."""

    def __init__(self, known: Vocabulary, pattern: str):
        self.vocabulary = known
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: Iterable[str]) -> None:
        """Merge the pieces that are not known yet."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode()
            if (whole := self.vocabulary.ranks.get(data)) is not None:
                self.known[piece] = whole.to_bytes(4, "little")
            elif len(data) > WIDE:
                self.known[piece] = np.array(merge_one(self.vocabulary, data), "<i4").tobytes()
            else:
                by_size.setdefault(1 << (len(data) - 1).bit_length(), []).append((piece, data))
        for size, found in by_size.items():
            for a in range(0, len(found), 20_000):
                some = found[a:a + 20_000]
                self.known.update(zip([p for p, _ in some], merge_many(self.vocabulary, [d for _, d in some], size)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        if len(self.known) > MEMORY:
            self.known.clear()
        split = [self.find(t) for t in texts]
        self.learn(set().union(*split).difference(self.known))
        return [b"".join(map(self.known.__getitem__, pieces)) for pieces in split]

    def encode_array(self, texts: pa.Array) -> pa.Array:
        flat, ends = bytearray(), [0]
        some, chars = [], 0

        def add() -> None:
            for packed in self.encode(some):
                flat.extend(packed)
                ends.append(len(flat) // 4)
            some.clear()

        for t in texts:
            some.append(t.as_py() or "")
            chars += len(some[-1])
            if chars > CHUNK_CHARS:
                add()
                chars = 0
        add()
        ids = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(flat)])  # no copy
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)


_VOCABULARIES: dict[int, Vocabulary] = {}
_ENCODERS: dict[tuple[int, str], Encoder] = {}


def vocabulary(rank_file: bytes) -> Vocabulary:
    """One vocabulary per worker and rank file."""
    key = hash(rank_file)
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Vocabulary(rank_file)
    return _VOCABULARIES[key]


def encoder(rank_file: bytes, pattern: str) -> Encoder:
    """One encoder per worker, rank file and pattern."""
    key = (hash(rank_file), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary(rank_file), pattern)
    return _ENCODERS[key]


def decode_array(known: Vocabulary, ids: pa.Array) -> pa.Array:
    """The bytes of each id sequence."""
    token, flat, ends = known.tokens.__getitem__, bytearray(), [0]
    for x in ids:
        if x.is_valid:
            flat.extend(b"".join(map(token, x.values.to_numpy(zero_copy_only=False).tolist())))
        ends.append(len(flat))
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.array(ends, "<i4")), pa.py_buffer(flat)])


def _shared(spark: SparkSession, rank_path: str):
    ship(spark)
    with open(rank_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text (an array of int) as column ``out``, which
    replaces an input column of that name."""
    ranks = _shared(df.sparkSession, rank_path)

    def encoded(texts: pa.Array) -> pa.Array:
        return encoder(ranks.value, pattern).encode_array(texts)

    own = fresh(df, "encoded_text")
    found = df.withColumn(own, F.arrow_udf(encoded, "array<int>")(text_or_empty(text)))
    return found.select(*[at(c) for c in without(df, out).columns], at(own).alias(out))


def decode(df: DataFrame, rank_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of each id sequence as column ``out``."""
    ranks = _shared(df.sparkSession, rank_path)

    def decoded(values: pa.Array) -> pa.Array:
        return decode_array(vocabulary(ranks.value), values)

    own = fresh(df, "decoded_ids")
    # coalesce: ids that come from ``encode`` are then made once, not again inside this call
    found = df.withColumn(own, F.arrow_udf(decoded, "binary")(F.coalesce(at(ids), F.array().cast("array<int>"))))
    return found.select(*[at(c) for c in without(df, out).columns], at(own).alias(out))
