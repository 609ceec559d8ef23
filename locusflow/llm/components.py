"""Connected components of an edge table by alternating large and small stars.

Each round is two shuffles of the edges left; the number of rounds grows with the logarithm
of the number of nodes.  Lineage is cut by reliable checkpoints, and nothing
but the edge count goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _large(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Links each node, and its smaller neighbours, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges ``(a, b)`` of longs; the component is its least node.

    Loops and repeated edges are allowed; no edges give no rows.
    """
    now = checkpointed(_small(edges))
    mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while True:
        now = checkpointed(_small(_large(now)))
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if was == mark:
            break
    # now every edge is (node, least node)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b"))).distinct()
