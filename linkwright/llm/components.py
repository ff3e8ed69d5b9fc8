"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (any one type). Returns node, root: the smallest node of its component.

    Alternates two steps until nothing changes: every larger neighbour of a node
    moves to the node's smallest neighbour, then every smaller one does. A node's
    neighbours are never gathered; only their minimum is taken, by an aggregation
    that combines before the shuffle. Each step is written to the shared folder, and so
    are the minima: the join back to the edges then reads two tables, and adaptive
    execution can split the edges of a node that has very many.
    """

    def hook(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        if larger:
            both = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        least = materialize(least, "least")
        joined = both.join(least, F.col("u") == F.col("w"))
        if larger:
            moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
            moved = moved.union(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
        return moved.where(F.col("a") != F.col("b")).distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = state(now)
    while True:
        now = materialize(hook(hook(now, larger=True), larger=False), "edges")
        if (found := state(now)) == seen:
            break
        seen = found
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
