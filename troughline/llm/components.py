"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from troughline.llm.common import keep


def _stars(pairs: DataFrame) -> DataFrame:
    """Large star: each larger neighbour of a node moves to the node's smallest neighbour."""
    both = pairs.union(pairs.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small(pairs: DataFrame) -> DataFrame:
    """Small star: each node and its smaller neighbours move to the smallest of them."""
    down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """`node, root`: every node of an edge table (`a`, `b`) and the smallest node it can reach.

    Each round writes the contracted edges to the shared folder; rounds grow with the logarithm of
    the longest chain. It ends when every edge points at the centre of its star.
    """
    pairs = keep(edges.where("a <> b").select("a", "b").distinct(), "edges")
    while True:
        pairs = keep(_small(_stars(pairs)).distinct(), "stars")
        # A star forest: no centre hangs on another centre, and no node hangs on two.
        chained = pairs.join(pairs.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        if not chained and not pairs.groupBy("a").count().where("count > 1").limit(1).count():
            break
    roots = pairs.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
