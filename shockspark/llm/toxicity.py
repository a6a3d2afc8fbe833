"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

Kernel of two words: they share a feature for every three characters that stand in both in
the same order within ``SPAN`` places; a feature that stretches over s places weighs
``DECAY ** s``.  So a letter put into an insult, or dots and stars between its letters, takes
away part of the likeness only.  Words carry a mark at either end, are normed by length,
and the likeness is squared (a product of kernels).  Kernel of two sentences: the sum over
their pairs of words.

Landmarks are words of the labelled texts: those most typical of toxic texts (a large family
of like words leaves room for others), their nearest
look-alikes in clean texts, and frequent clean words.  With the Nyström map of these
landmarks the machine is linear, so a sentence's margin is the sum of its words' values and
each distinct word is valued once per worker (a bounded memory, forgotten when full).

Training: sentences of the labelled texts, first labelled as their text; then, twice, the
sentences of toxic texts that fall on the clean side count as clean (each toxic text keeps
its best sentence) and the machine is fitted again.  Words that this machine of sentences
values above ``SUSPECT`` are the evidence of a text.  The machine of texts has the same
kernel over the different words of evidence of a text (a text is one long sentence of
them) and is trained on the labelled texts and the empty one, a clean text that weighs
``EMPTY`` of all; its margin is the sum of its words' values.  The score is this margin
calibrated by a logistic function of its own (Platt), fitted on the labelled texts' margins
by machines trained without them (``FOLDS`` folds), with the classes weighted as they occur.

Learning uses at most ``MAX_TEXTS`` labelled texts of each class (the least by a hash of
the id), of these the ones of at most ``MAX_CHARS`` characters, and for the first machine at
most ``MAX_SENTENCES`` of their sentences of each class (evenly spaced ones); scoring reads
whole texts of any length.  Features are made of the ``CODES - 3`` commonest characters of
the landmarks; a triple with another character counts for nothing.

Defined results: null and empty texts have no evidence and the score of all such texts,
that of the machine's bias; equal texts get equal scores; a training set without one of
the classes gives the share of toxic labels (0 without labels) as every score; an empty table gives an empty
table; input columns that clash with output names are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockspark.llm.common import at, fresh, ship, text_or_empty, without

DECAY, SPAN, LONGEST, CODES = 0.75, 5, 30, 128
GAPS = [(a, b) for a in range(1, SPAN - 1) for b in range(a + 1, SPAN)]
LANDMARKS = (60, 24, 12)
CANDIDATES, CROWD = 400, 2.5
SUSPECT, RIDGE, FOLDS, EMPTY = -0.5, 1.0, 5, 0.1
MAX_TEXTS, MAX_CHARS, MAX_SENTENCES, MEMORY = 1000, 50_000, 25_000, 500_000
SENTENCE_END = re.compile(r"[.!?]+(?=\s|$)|\n")
NO_WORD = re.compile(r"[\W_]+")
COMMON = ".,;:!?\"'()*#$%&-"


def tokens_of(text: str) -> list[str]:
    """The lower-case tokens of a text without the commonest characters that are no part of
    a word."""
    text = text.lower()
    for mark in COMMON:
        if mark in text:
            text = text.replace(mark, "")
    return text.split()


def words_of(token: str) -> list[str]:
    """The word of a lower-case token without white space: its letters and digits; a very
    long one is cut into overlapping pieces."""
    word = token if token.isalnum() else NO_WORD.sub("", token)
    if len(word) > LONGEST:
        return [word[i:i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]
    return [word] if word else []


def spelled_words(tokens: list[str]) -> list[str]:
    """Words spelled letter by letter: three or more tokens in a row with one letter each
    (tokens without any are skipped)."""
    if sum(len(t) < 3 for t in tokens) < 3:
        return []
    out, run = [], []
    for token in [*tokens, "end"]:
        word = token if token.isalnum() else NO_WORD.sub("", token) if len(token) < 4 else token
        if len(word) == 1:
            run.append(word)
        elif word:
            if len(run) > 2:
                out += words_of("".join(run))
            run = []
    return out


def sentence_words(text: str) -> list[list[str]]:
    """The words of each sentence that has any."""
    out = []
    for sentence in SENTENCE_END.split(text.lower()):
        tokens = sentence.split()
        words = [w for token in tokens for w in words_of(token)] + spelled_words(tokens)
        if words:
            out.append(words)
    return out


def _features(words: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, weight) of every known feature of the words; ``codes``: the code of
    every character, 0 for one that no landmark has."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "replace"), "<u4")
    size = int(lengths.max())
    table = np.zeros((len(words), size + SPAN), np.int32)
    table[:, :size][np.arange(size) < lengths[:, None]] = codes[points]
    rows, features, weights = [], [], []
    for a, b in GAPS:
        x, y, z = table[:, :size], table[:, a:size + a], table[:, b:size + b]
        r, i = np.nonzero((x > 0) & (y > 0) & (z > 0))
        rows.append(r)
        features.append((x[r, i] * CODES + y[r, i]) * CODES + z[r, i])
        weights.append(np.full(len(r), DECAY ** (b + 1)))
    return np.concatenate(rows), np.concatenate(features), np.concatenate(weights)


def _norm(words: list[str]) -> np.ndarray:
    """Norm of a word by its length: that of a word whose features all differ."""
    most = max(map(len, words)) + 2
    by_length = [math.sqrt(sum(max(0, n - b) * DECAY ** (2 * (b + 1)) for _, b in GAPS)) or 1.0 for n in range(most + 1)]
    return np.array([by_length[len(w) + 2] for w in words])


@dataclass
class Landmarks:
    words: list[str]

    def __post_init__(self):
        common = Counter(c for w in self.words for c in w).most_common(CODES - 3)
        self.codes = np.zeros(0x110000, np.int32)
        for i, point in enumerate([2, 3, *(ord(c) for c, _ in common)]):
            self.codes[point] = i + 1
        rows, features, weights = _features(self.words, self.codes)
        known, self.place = np.unique(features), np.full(CODES ** 3, -1, np.int32)
        self.place[known] = np.arange(len(known))
        self.matrix = np.zeros((len(known), len(self.words)), np.float32)
        np.add.at(self.matrix, (self.place[features], rows), weights)
        self.matrix /= _norm(self.words)

    def kernel(self, words: list[str]) -> np.ndarray:
        """Kernel of every word with every landmark."""
        if not words:
            return np.zeros((0, len(self.words)), np.float32)
        rows, features, weights = _features(words, self.codes)
        place = self.place[features]
        hit = place >= 0
        shape = (len(words), len(self.matrix))
        counts = np.bincount(rows[hit] * shape[1] + place[hit], weights[hit], shape[0] * shape[1])
        out = counts.astype(np.float32).reshape(shape) @ self.matrix
        return (out / _norm(words)[:, None].astype(np.float32)) ** 2


@dataclass
class ToxicityModel:
    """Landmarks; each landmark's weight in the value of a word by the machine of sentences
    (first row) and by that of texts (second row); what every word's value has besides; the
    logistic function of a text's margin: its value at no evidence, and its slope."""

    landmarks: Landmarks | None
    weights: np.ndarray
    bias: tuple[float, float]
    logit: np.ndarray
    known: dict[str, tuple] = field(default_factory=dict)

    def learn(self, tokens: list[str]) -> None:
        """The words of evidence, with their values, of tokens not met before."""
        plain, odd = [], []
        for t in tokens:
            (plain if len(t) <= LONGEST and t.isalnum() else odd).append(t)
        pieces = {t: words_of(t) for t in odd}
        words = [*plain, *{w for ws in pieces.values() for w in ws}]
        found = {}
        for a in range(0, len(words), 2000):
            some = words[a:a + 2000]
            margin, evidence = (self.landmarks.kernel(some) @ self.weights.T + np.array(self.bias)).T
            found.update((some[i], ((some[i], float(evidence[i])),)) for i in np.flatnonzero(margin > SUSPECT))
        self.known.update(dict.fromkeys(plain, ()))
        self.known.update((t, found[t]) for t in plain if t in found)
        self.known.update((t, tuple(pair for w in ws for pair in found.get(w, ()))) for t, ws in pieces.items())

    def evidence(self, tokens: list[str]) -> list[float]:
        """The values of a text's different words of evidence."""
        if len(self.known) > MEMORY:
            self.known.clear()
        different = {*tokens, *spelled_words(tokens)}
        new = different.difference(self.known)
        if new:
            self.learn(list(new))
        return list(dict(pair for found in filter(None, map(self.known.__getitem__, different)) for pair in found).values())

    def score(self, text: str) -> float:
        """Likelihood of label 1: the calibrated margin of the text."""
        if self.landmarks is None:
            return float(self.logit[0])
        tokens = tokens_of(text)
        # summed exactly, so that the order of the words does not matter
        z = float(self.logit[0] + self.logit[1] * math.fsum(self.evidence(tokens)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _spread(words: list[str], most: int) -> list[str]:
    """The first words that are not crowded by earlier ones (by the sum of their kernels), so
    that a large family of words leaves room for others; filled up in order."""
    if not words:
        return []
    kernel = Landmarks(words).kernel(words)
    taken, crowd = [], np.zeros(len(words))
    for i in range(len(words)):
        if len(taken) < most and crowd[i] < CROWD:
            taken.append(i)
            crowd += kernel[i]
    rest = [i for i in range(len(words)) if i not in set(taken)]
    return [words[i] for i in sorted(taken + rest[:most - len(taken)])]


def choose_landmarks(words: list[str], toxic: np.ndarray, clean: np.ndarray, texts: tuple[int, int]) -> Landmarks:
    """Words typical of the toxic texts, look-alikes in clean texts, frequent clean words;
    ``toxic`` and ``clean``: in how many texts of each class a word stands, ``texts``: the
    number of texts of each class."""
    odds = np.log((toxic + 0.5) / (texts[0] + 1) * (texts[1] + 1) / (clean + 0.5))
    order = np.lexsort((np.array(words), -toxic * odds))
    likely = [words[i] for i in order if toxic[i] > 1 and odds[i] > 1][:CANDIDATES]
    typical = _spread(likely, LANDMARKS[0]) or [words[i] for i in np.argsort(-toxic, kind="stable")[:LANDMARKS[0]]]
    first = Landmarks(typical)
    others = [i for i in np.lexsort((np.array(words), -clean)) if clean[i] and odds[i] < 0]
    near = np.zeros(len(others))
    for a in range(0, len(others), 2000):
        near[a:a + 2000] = first.kernel([words[i] for i in others[a:a + 2000]]).max(1)
    alike = np.argsort(-near * np.log1p(clean[others]), kind="stable")[:LANDMARKS[1]]
    return Landmarks(list(dict.fromkeys([*typical, *(words[others[i]] for i in alike), *(words[i] for i in others[:LANDMARKS[2]])])))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton steps; the last
    column of ``x`` is the bias and is not penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    active = np.ones(len(y), bool)
    for _ in range(25):
        left, right = np.diag(penalty), np.zeros(x.shape[1])
        for a in range(0, len(y), 8192):  # in blocks, to hold one block in double precision
            some = active[a:a + 8192]
            block, c = x[a:a + 8192][some].astype(np.float64), weight[a:a + 8192][some]
            left = left + (block * c[:, None]).T @ block
            right += block.T @ (c * y[a:a + 8192][some])
        w = np.linalg.solve(left, right)
        now = y * (x @ w) < 1
        if (now == active).all():
            break
        active = now
    return w


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1]), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str], labels: list[int], toxic_share: float) -> ToxicityModel:
    """The model of labelled texts; ``toxic_share``: how often label 1 occurs."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(None, np.zeros((2, 0)), (0.0, 0.0), np.array([toxic_share]))
    vocabulary: dict[str, int] = {}
    flat, ends = [], []  # word numbers of each text, and where its sentences end
    for text in texts:
        sentences = sentence_words(text)
        flat.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for s in sentences for w in s], np.int32))
        ends.append(np.cumsum([len(s) for s in sentences], dtype=np.int32))
    words = list(vocabulary)
    if not words:
        return ToxicityModel(None, np.zeros((2, 0)), (0.0, 0.0), np.array([toxic_share]))
    standing = np.zeros((2, len(words)), np.int64)
    for t, numbers in enumerate(flat):
        standing[y[t], np.unique(numbers)] += 1
    landmarks = choose_landmarks(words, standing[1], standing[0], (int(y.sum()), int(len(y) - y.sum())))
    own = landmarks.kernel(landmarks.words).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-3
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nyström: features = kernel @ root
    mapped = np.zeros((len(words), root.shape[1]), np.float32)
    for a in range(0, len(words), 2000):
        mapped[a:a + 2000] = landmarks.kernel(words[a:a + 2000]) @ root
    every = [max(1, math.ceil(sum(len(e) for e, z in zip(ends, y) if z == c) / MAX_SENTENCES)) for c in (0, 1)]
    rows, owner = [], []
    for t, (numbers, end) in enumerate(zip(flat, ends)):
        if len(end):
            sums = np.add.reduceat(mapped[numbers], np.r_[0, end[:-1]], axis=0)[t % every[y[t]]::every[y[t]]]
            rows.append(sums)
            owner += [t] * len(sums)
    x = np.ones((len(owner), root.shape[1] + 1), np.float32)
    x[:, :-1] = np.concatenate(rows)
    del rows
    owner = np.array(owner)
    of = y[owner]
    sign = np.where(of == 1, 1.0, -1.0)
    for _ in range(3):
        share = max(1, (sign > 0).sum()) / len(sign)
        w = _machine(x, sign, np.where(sign > 0, 1.0, max(0.05, min(1.0, 3 * share / (1 - share + 1e-9)))))
        margin = x @ w
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, owner, margin)
        sign = np.where((of == 1) & ((margin > 0) | (margin >= best[owner])), 1.0, -1.0)
    suspect = mapped @ w[:-1] + w[-1] > SUSPECT
    told = np.hstack([mapped[suspect], np.ones((int(suspect.sum()), 1), np.float32)]).astype(np.float64)
    place = np.cumsum(suspect) - 1
    bags = np.ones((len(y) + 1, told.shape[1] + 1))
    bags[-1, :-1] = 0.0  # the empty text, which is clean, seen by every machine and weighs EMPTY of all
    for t, numbers in enumerate(flat):
        different = np.unique(numbers)
        bags[t, :-1] = told[place[different[suspect[different]]]].sum(0)
    sign, costs, fold = np.append(np.where(y == 1, 1.0, -1.0), -1.0), np.append(np.where(y == 1, 2.0, 1.0), EMPTY * len(y)), np.append(np.arange(len(y)) % FOLDS, FOLDS)
    u, margin = _machine(bags, sign, costs, RIDGE), np.zeros(len(y))
    for f in range(FOLDS):  # margins by machines that have not seen the text
        margin[fold[:-1] == f] = bags[fold == f] @ _machine(bags[fold != f], sign[fold != f], costs[fold != f], RIDGE)
    start, slope = _logistic(np.stack([np.ones(len(y)), margin], 1), y, np.where(y == 1, toxic_share / y.mean(), (1 - toxic_share) / (1 - y.mean())))
    weights = np.stack([root @ w[:-1], root @ u[:-2]]).astype(np.float32)
    return ToxicityModel(landmarks, weights, (float(w[-1]), float(u[-2])), np.array([start + slope * u[-1], slope]))


def held_out(key: Column) -> Column:
    """Whether a row is kept out of learning: CRC-32 of the key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """The model of the labelled rows of ``docs`` that are not held out.  A key with
    several labels has the largest, a key with several texts one of them.  Texts of more
    than ``MAX_CHARS`` characters are not learned from."""
    known = (labels.select(at(key).alias("key"), at(label).cast("int").alias("label")).filter("key is not null and label in (0, 1)")
             .filter(~held_out(F.col("key"))).groupBy("key").agg(F.max("label").alias("label")))
    counts = dict(known.groupBy("label").count().collect())  # two rows at most
    drawn = [known.filter(F.col("label") == y).orderBy(F.xxhash64("key"), "key").limit(MAX_TEXTS) for y in (0, 1)]
    some = drawn[0].union(drawn[1])  # at most 2 * MAX_TEXTS rows
    texts = docs.select(at(key).alias("key"), text_or_empty(text).alias("text")).join(F.broadcast(some), "key").filter(F.char_length("text") <= MAX_CHARS)
    rows = texts.groupBy("key").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label")).collect()
    rows.sort(key=lambda r: r.key)
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit([r.text for r in rows], [r.label for r in rows], share)


def scores(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the score of each whole text (0 to 1, higher: label 1 likelier)."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t.as_py()) for t in texts], pa.float64())

    own = fresh(df, "toxicity_score")
    found = df.withColumn(own, F.arrow_udf(scored, "double")(text_or_empty(text)))
    return found.select(*[at(c) for c in without(df, out).columns], at(own).alias(out))


def keep_clean(df: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` whose score is below ``threshold``, with their own columns only."""
    own = fresh(df, "toxicity")
    return scores(df, model, text, own).filter(at(own) < threshold).drop(own)
