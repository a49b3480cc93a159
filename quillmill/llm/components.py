"""Connected components of a graph given as edges, by alternating large and small stars.

Each round is a handful of joins and partial aggregations over the edges; the number of rounds grows with the logarithm of a
component's size, not with its diameter. Labels and edges stay distributed and are written to the shared folder after every
round, so a lost executor costs at most a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (u, v) with m, the least of u and its neighbours; and the table (u, m). As a table it leaves Spark free to split the join at a node with very many edges."""
    least = materialise(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    return edges.join(least, "u"), least


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: columns u and v. Returns (node, root) for every node with an edge; root is the least node of its component."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialise(e)
    for _ in range(max_rounds):
        both, least = _with_least(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct())
        discard(e, least)
        # small star: everything not larger than u, and u itself, goes to the least of them
        joined, least = _with_least(large)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = materialise(small.where("u <> v").distinct())
        discard(large, least)
        # done when every node has one parent, and no parent has one
        stars = e.groupBy("u").count()
        tall = e.select("v").distinct().join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if stars.where("count > 1").isEmpty() and tall.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
    raise RuntimeError("components did not settle")
