"""Connected components of a graph given as edges, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billscope.shared import settle


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the smallest node reachable.

    A round points all larger neighbours of a node at its smallest one, then all smaller ones.
    Both steps aggregate before they shuffle, and join edges with one row per node, so a node with
    very many neighbours only makes a skewed join that Spark splits. Each round is written to the
    shared folder; rounds grow with the logarithm of the longest path. Null ends and loops are left out.
    """
    now = settle(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    weight = _weight(now)
    while weight[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        now = settle(_star(large, large))
        after = _weight(now)
        if after == weight:
            break
        weight = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).distinct()


def _star(neighbours: DataFrame, moved: DataFrame) -> DataFrame:
    """Edges ``moved`` (a, b) with b pointed at the least of a and its ``neighbours``; a as well."""
    least = neighbours.groupBy("a").agg(F.min("b").alias("_low")).select("a", F.least("a", "_low").alias("low"))
    pointed = moved.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return pointed.unionByName(least.select("a", F.col("low").alias("b"))).where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()


def _weight(edges: DataFrame) -> tuple[int, int]:
    """Counts that no longer change once all edges are stars around the smallest nodes."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s
