"""Connected components of a link table, as joins and groupings only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm._common import materialize


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that occurs in links(a, b); component: the smallest node.

    Alternating large-star and small-star rounds: each is one grouping by node with a join of
    its minimum, so no neighbourhood is ever gathered. Links shrink to stars in a number of
    rounds logarithmic in the longest path; each round is written to the shared folder.
    """
    edges = materialize(_ordered(links.select("a", "b")))
    for _ in range(max_rounds):
        large = _large_star(edges)
        new = materialize(_small_star(large))
        # At the fixed point every node hangs on one centre and no centre hangs on another.
        state = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        before = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        edges = new
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links with a > b."""
    return links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m"))
    # Only edges (node, larger neighbour): node is b of an ordered edge.
    return edges.join(least, edges.b == least.node).select("a", F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked with its smallest neighbour."""
    edges = _ordered(edges)
    least = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    moved = edges.join(least, edges.a == least.node).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(moved.unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))))
