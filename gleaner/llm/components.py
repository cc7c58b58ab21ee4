"""Connected components of a link table, by star contraction on shuffles alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    both = F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))
    return edges.join(least, "a").select(F.explode(both).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root) for each node of the links (a, b): root is the least node of its component.

    Links from a node to itself and repeated links change nothing; a null end drops the link. Nodes without
    links are not returned. Each round is two shuffles per star; its links are checkpointed, so a lost
    executor repeats one round at most. Links never grow: a star makes one link for each it gets. Rounds grow
    as the logarithm of the longest path; a fixed point is told by two sums that executors compute.
    """
    links = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    links = cut(links.where("a > b").distinct())
    before = None
    for _ in range(max_rounds):
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now.n == 0 or now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = now
        links = cut(_small_star(_large_star(links)))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
