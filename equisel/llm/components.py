"""Connected components of an edge table, by alternating large and small stars
(Kiveris et al., 2014). Every round is a map-side minimum per node and an
equi-join with that minimum; a hub's edges stay separate rows, and both join
sides come from written tables or plain exchanges, so a hub can be split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import written


def _least(both: DataFrame, name: str, files: int | None) -> DataFrame:
    """Each node's least neighbour, itself included."""
    return written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name, files)


def _large(edges: DataFrame, files: int | None) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both, "large", files), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small(edges: DataFrame, files: int | None) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least."""
    least = _least(edges, "small", files)
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def _settled(stars: DataFrame) -> bool:
    """Whether every node has one parent and no parent has one itself."""
    parents = stars.select(F.col("v").alias("u")).distinct().withColumn("is_parent", F.lit(1))
    each = stars.groupBy("u").agg(F.count(F.lit(1)).alias("n")).join(parents, "u", "left")
    return each.where("n > 1 OR is_parent = 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b", files: int | None = None, max_rounds: int = 100) -> DataFrame:
    """(node, component): the least node that each node of the edge table
    reaches. Self-loops and repeated edges are harmless; nodes that are their
    own component are left out, null ends are dropped."""
    stars = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    stars = written(stars, "edges", files)
    for _ in range(max_rounds):
        if _settled(stars):
            break
        stars = written(_small(written(_large(stars, files), "stars", files), files), "stars", files)
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
