"""Connected components by alternating large-star and small-star, over edges kept as a checkpointed DataFrame.

Edges point from the greater node u to the smaller one v. The least neighbour of a node that is smaller than itself comes from one
sum with map-side combining, is checkpointed and joined back to the edges; both sides of that join are plain shuffles, so a
node with very many edges is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checkpoint


def least_neighbours(edges: DataFrame) -> DataFrame:
    """(u, low, n): the least smaller neighbour of each node that has any, and how many there are."""
    return checkpoint(edges.groupBy("u").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("n")))


def large_star(edges: DataFrame, low: DataFrame) -> DataFrame:
    """(u, v, up): an edge, and the least neighbour of v where that is smaller than v. Large-star links u to it instead of v."""
    return checkpoint(edges.join(low.select(F.col("u").alias("v"), F.col("low").alias("up")), "v", "left").select("u", "v", "up"))


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    linked = edges.join(least_neighbours(edges).drop("n"), "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v"))
    return checkpoint(linked.filter("u > v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; a component is named after its least node. edges: u, v (long)."""
    now = checkpoint(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        low = least_neighbours(now)
        met = large_star(now, low)
        # Stars are left alone: no smaller end has a smaller neighbour, and no greater end has two.
        moved = met.select(F.col("up").isNotNull().alias("moved")).unionByName(low.select((F.col("n") > 1).alias("moved")))
        if not moved.agg(F.max("moved")).first()[0]:
            break
        now = small_star(met.select("u", F.coalesce("up", "v").alias("v")))
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return checkpoint(nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
