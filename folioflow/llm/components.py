"""Connected components of a table of links, by alternating large and small stars.

Each round joins links with each node's smallest neighbour, so a node with very many links is
pre-aggregated before the shuffle and its rows can be split in the join. The number of rounds grows
with the logarithm of the longest path. Nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import cut


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large(links: DataFrame) -> DataFrame:
    """Larger neighbours of each node are linked with the smallest of its neighbourhood."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("low"))
    return both.filter("b > a").join(least, F.col("a") == F.col("node")).filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, are linked with the smallest of them; a is above b."""
    least = links.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "node")
    others = links.join(least, F.col("a") == F.col("node")).filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return others.union(least.select(F.col("node").alias("a"), F.col("low").alias("b"))).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has a link to another; a component is named by its smallest node.

    links: columns a, b. Links of a node with itself say nothing and are dropped; repeated links count once;
    an empty table gives an empty result.
    """
    links = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(links)
    for _ in range(max_rounds):
        links = cut(_small(_large(links)))
        now = _mark(links)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components didn't settle")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
