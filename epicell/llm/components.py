"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epicell.session import settle


def _neighbours_least(edges: DataFrame) -> DataFrame:
    """Every directed edge (u, v) with `least`, the smallest of u and all its neighbours here.

    The least of a node is a partial aggregate. It is written before it is joined back, so that both sides of the
    join are bare shuffles and the runtime splits the edges of a node that a third of all edges meet.
    """
    least = settle(edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("least")), "least")
    return edges.join(least, "u")


def _contract(edges: DataFrame) -> DataFrame:
    """One round on edges u > v: larger neighbours, then smaller ones, move to the least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _neighbours_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
    large = settle(large, "components")
    small = _neighbours_least(large)
    moved = small.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    own = small.select("u", F.col("least").alias("v"))
    return settle(moved.unionByName(own).where("u <> v").distinct(), "components")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node on an edge; the component is its smallest node.

    Edges with a NULL end or with equal ends are left out; direction and repetition do not matter. Each round is
    written to the shared folder; rounds end when all edges point at roots.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = settle(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "components")
    while True:
        # a forest of stars: no node has two edges, and no target has an edge of its own
        checked = now.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        twice = checked.where("n > 1").limit(1).count()
        if not twice and not now.select(F.col("v").alias("u")).join(checked.select("u"), "u", "left_semi").limit(1).count():
            break
        now = _contract(now)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
