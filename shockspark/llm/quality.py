"""Quality rules by repetition coverage.

Every word of a text gets a code; polynomial rolling hashes of the code sequence (mod
2**64, built by doubling, so an n-gram hash costs a few vector operations) name the
n-grams.  An n-gram that occurs twice or more marks all its occurrences, first included;
the coverage of a length is the share of word characters inside marked words.  A line is
duplicated when it equals an earlier line; its words' characters are covered, too.

Defined results: a null or empty text has zero words and fails the base rule; a text
shorter than an n-gram has coverage 0; equal rows get equal results; an empty table gives
an empty table; columns of the input that clash with output names are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockspark.llm.common import WORD, at, fresh, ship, text_or_empty, without

BASE = np.uint64(0x9E3779B97F4A7C15)
#: n-gram lengths with the largest share of word characters that duplicated n-grams may cover.
GRAMS = ((5, 0.40), (8, 0.30), (13, 0.25))
FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          + ", ".join(f"cover_{n} double" for n, _ in GRAMS) + ", cover_lines double, base_failed boolean, kept boolean")


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    grams: tuple[tuple[int, float], ...] = GRAMS
    max_line_cover: float = 0.30
    symbols: str = "#*$%&|<>"


def _mixed(codes: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit values of small integers (a finalizer of the splitmix kind)."""
    with np.errstate(over="ignore"):
        x = (codes.astype(np.uint64) + np.uint64(1)) * BASE
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Rolling:
    """Rolling hashes of all n-grams of one sequence of codes."""

    def __init__(self, codes: np.ndarray):
        self.of = {1: _mixed(codes)}

    def grams(self, n: int) -> np.ndarray:
        if n not in self.of:
            left = 1 << (n - 1).bit_length() - 1
            a, b = self.grams(left), self.grams(n - left)
            with np.errstate(over="ignore"):
                power = np.uint64(pow(int(BASE), n - left, 1 << 64))
                size = max(0, len(a) - (n - left))
                self.of[n] = a[:size] * power + b[left:left + size]
        return self.of[n]

    def covered(self, n: int, words: int) -> np.ndarray:
        """Which words lie in an n-gram that occurs at least twice."""
        if words < n + 1:
            return np.zeros(words, bool)
        h = self.grams(n)
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        if not same.any():
            return np.zeros(words, bool)
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        steps = np.zeros(words + 1, np.int64)
        np.add.at(steps, np.flatnonzero(twice), 1)
        np.add.at(steps, np.flatnonzero(twice) + n, -1)
        return np.cumsum(steps[:-1]) > 0


def measure(text: str, rules: QualityRules) -> tuple:
    """All figures of one text, in the order of ``FIELDS``."""
    find = re.compile(WORD)
    words = find.findall(text)
    n = len(words)
    known: dict[str, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    chars = np.fromiter(map(len, words), np.int64, n)
    total = int(chars.sum())
    symbols = sum(map(text.count, rules.symbols))
    seen: set[str] = set()
    dup_lines = dup_chars = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += 1
            dup_chars += sum(map(len, find.findall(line)))
        elif find.search(line):
            seen.add(line)
    roll = Rolling(codes)
    repeat = int(roll.covered(rules.window, n).sum())
    cover = [float(chars[roll.covered(g, n)].sum() / total) if total else 0.0 for g, _ in rules.grams]
    lines = dup_chars / total if total else 0.0
    failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
    kept = not failed and lines <= rules.max_line_cover and all(c <= most for c, (_, most) in zip(cover, rules.grams))
    return (n, total, symbols, dup_lines, repeat, *cover, lines, failed, kept)


def quality_rules(docs: DataFrame, text: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """``docs`` with the figures and the verdict ``kept`` of every whole text."""
    ship(docs.sparkSession)
    fields = FIELDS if rules.grams == GRAMS else FIELDS.replace(
        ", ".join(f"cover_{n} double" for n, _ in GRAMS), ", ".join(f"cover_{n} double" for n, _ in rules.grams))
    names = [f.split()[0] for f in fields.split(", ")]

    def judged(texts: pa.Array) -> pa.Array:
        rows = [measure(t.as_py(), rules) for t in texts]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        return pa.StructArray.from_arrays(
            [pa.array(c, kinds[f.split()[1]]) for c, f in zip(columns, fields.split(", "))], names=names)

    udf = F.arrow_udf(judged, fields)
    own = fresh(docs, "quality")
    found = docs.withColumn(own, udf(text_or_empty(text)))
    return found.select(*[at(c) for c in without(docs, *names).columns], *[at(own)[n].alias(n) for n in names])


def keep_quality(docs: DataFrame, text: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns only."""
    own = fresh(docs, "quality_kept")
    ship(docs.sparkSession)

    def kept(texts: pa.Array) -> pa.Array:
        return pa.array([measure(t.as_py(), rules)[-1] for t in texts], pa.bool_())

    udf = F.arrow_udf(kept, "boolean")
    return docs.withColumn(own, udf(text_or_empty(text))).filter(at(own)).drop(own)
