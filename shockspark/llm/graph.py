"""Connected components of a link table by contraction, all in Spark.

Each round lets every node point at the least of itself and its neighbours, follows the
pointers twice, and replaces the links by the distinct links between the nodes pointed
at.  Every round at least halves the nodes of a component that still has links, so the
number of rounds is logarithmic in the largest component, chains included.  Minima are
pre-aggregated before their shuffle and each round's tables are written to the shared
folder; nothing but "is a link left" reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shockspark.llm.common import written


def _follow(parents: DataFrame) -> DataFrame:
    """Pointers to the parent's parent."""
    upper = parents.select(F.col("node").alias("parent"), F.col("parent").alias("upper"))
    return parents.join(upper, "parent", "left").select("node", F.coalesce("upper", "parent").alias("parent"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (columns a, b; undirected): root is the least
    node of its component."""
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .filter("a < b").distinct(), "links")
    both = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node")))
    labels = both.distinct().withColumn("root", F.col("node"))
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(
            links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        parents = written(ends.groupBy("node").agg(F.min("other").alias("least"))
                          .select("node", F.least("node", "least").alias("parent")), "parents")
        parents = written(_follow(_follow(parents)), "parents")
        to = parents.withColumnRenamed("node", "root")
        labels = written(labels.join(to, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "labels")
        a, b = (parents.select(F.col("node").alias(c), F.col("parent").alias(f"to_{c}")) for c in "ab")
        links = written(links.join(a, "a").join(b, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
                        .filter("a < b").distinct(), "links")
    return labels
