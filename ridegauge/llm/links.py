"""Connected components of links, by alternating large-star and small-star rounds over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ridegauge.llm.common import discard, materialize


def connected(links: DataFrame) -> DataFrame:
    """node, root for each end of the links (a, b): the root is the smallest node that it reaches.

    A round only ever joins a node's links with one minimum a node, so hubs of any degree are aggregated before they are shuffled
    and skewed joins can be split. Rounds end as soon as every node hangs on its root, which one aggregation tells; links that come as stars
    take none.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = materialize(edges.distinct())
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # No more rows than both; copies go with the round's last step.
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        last, edges = edges, materialize(large.join(down, "a").select(F.inline(hung)).filter("a <> b").distinct())
        discard(last)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each node of the distinct edges (a > b) either has one edge down or is one that others hang on."""
    ends = F.array(
        F.struct(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("held")),
        F.struct(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("held")),
    )
    nodes = edges.select(F.inline(ends)).groupBy("node").agg(F.sum("down").alias("down"), F.max("held").alias("held"))
    return nodes.filter("down > 1 OR down = 1 AND held = 1").isEmpty()
