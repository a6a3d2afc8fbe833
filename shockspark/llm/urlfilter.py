"""URL filter: a trie over reversed host labels, with path tries at its nodes.

The rules (host, path, verdict) are a bounded list in the driver (``MAX_RULES``); the trie
is broadcast and every url walks it once, so the work per url is its number of labels and
segments whatever the number of rules.  A rule fits its host and all subdomains when the
url's path starts with the rule's path.  The longest fitting rule wins: most characters of
host plus path, then the longer host, then block before allow.  No fitting rule: the
default verdict.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
from there up to ``?``, ``#`` or the end.  A null url or one without ``://`` has an empty
host and path.  Equal urls get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shockspark.llm.common import at, fresh, ship, without

#: Largest rule list that is broadcast as one trie.
MAX_RULES = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Node:
    """One host label or path segment.  ``ends``: rules whose path ends inside the next
    segment, by the text that segment starts with."""

    children: dict[str, "Node"] = field(default_factory=dict)
    paths: "Node | None" = None
    ends: dict[str, tuple] = field(default_factory=dict)


class RuleTrie:
    def __init__(self, rules: list[tuple[str, str, str]]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; a broadcast trie takes at most {MAX_RULES}")
        self.root = Node()
        for host, path, verdict in rules:
            host = host.translate(str.maketrans(UPPER, LOWER))
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.children.setdefault(label, Node())
            if node.paths is None:
                node.paths = Node()
            node = node.paths
            *whole, last = path.split("/")
            for segment in whole:
                node = node.children.setdefault(segment, Node())
            rank = (len(host) + len(path), len(host), verdict == "block", host + path, verdict)
            node.ends[last] = max(rank, node.ends.get(last, rank))

    @staticmethod
    def _in_path(node: Node, segments: list[str], best: tuple | None) -> tuple | None:
        for segment in segments:
            for n in range(len(segment) + 1) if len(node.ends) > len(segment) else ():
                if (rank := node.ends.get(segment[:n])) and (best is None or rank > best):
                    best = rank
            if len(node.ends) <= len(segment):
                for start, rank in node.ends.items():
                    if segment.startswith(start) and (best is None or rank > best):
                        best = rank
            if (node := node.children.get(segment)) is None:
                break
        return best

    def judge(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest fitting rule, or two nulls."""
        segments, node, best = path.split("/"), self.root, None
        if node.paths:
            best = self._in_path(node.paths, segments, best)
        for label in reversed(host.split(".")) if host else ():
            if (node := node.children.get(label)) is None:
                break
            if node.paths:
                best = self._in_path(node.paths, segments, best)
        return (best[3], best[4]) if best else (None, None)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url by the rules above, as expressions."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    whole = F.regexp_extract(text, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(whole, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(whole, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def filter_urls(df: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with columns host, path, rule (``host + path`` of the winning rule, else
    null) and verdict; input columns of these names are replaced (the url column stays
    readable under its own name unless it is one of them)."""
    spark = df.sparkSession
    ship(spark)
    trie = spark.sparkContext.broadcast(RuleTrie(rules))

    def judged(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        found = [trie.value.judge(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist())]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())],
            names=["rule", "verdict"])

    udf = F.arrow_udf(judged, "rule string, verdict string")
    own = fresh(df, "url_parts")
    host, path = host_and_path(at(url))
    parts = df.withColumn(own, F.struct(host.alias("host"), path.alias("path")))
    judged_by = fresh(parts, "url_judged")
    parts = parts.withColumn(judged_by, udf(at(own)["host"], at(own)["path"]))
    keep = [at(c) for c in without(df, "host", "path", "rule", "verdict").columns]
    return parts.select(*keep, at(own)["host"].alias("host"), at(own)["path"].alias("path"),
                        at(judged_by)["rule"].alias("rule"),
                        F.coalesce(at(judged_by)["verdict"], F.lit(default)).alias("verdict"))
