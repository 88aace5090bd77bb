"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Edges of a task, about.
EDGES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of an edge (a, b); a component is named by its smallest vertex.

    Large-star and small-star contraction until nothing changes: the rounds grow
    with the logarithm of a component's size.  Smallest neighbours are found by
    aggregates and written before they are joined back, so Spark can split the
    edges of a vertex with a great many neighbours.
    """
    current = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    # Every round moves all edges: few of them need few tasks and files.
    parts = 1 + current.count() // EDGES
    state = None
    while True:
        current = _star(current, True, parts)
        current = _star(current, False, parts)
        now = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            return current.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(
                current.select(F.col("v").alias("v"), F.col("v").alias("component")).distinct())
        state = now


def _star(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """Connect neighbours (all larger ones, or all smaller ones and the vertex) to the smallest."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    low = cut_lineage(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(parts))
    met = near.join(low, "u")
    out = (met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else
           met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))))
    return cut_lineage(out.filter("u <> v").distinct().coalesce(parts))
