"""Connected components of a graph given by its edges, by alternating stars.

Every round points the larger neighbours of a node at the smallest node it knows (large star), then
the smaller ones (small star). Both are one minimum per node, combined before the shuffle, and one
join; no list of neighbours is gathered, so a node that a third of all edges meet is no special case.
The rounds end when the edges no longer change, after a number of rounds that grows with the
logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.lineage import settle


def _point_to_least(arcs: DataFrame) -> DataFrame:
    """arcs (a, b), read as 'a knows b': every b is pointed at the least node that a knows, or at a."""
    least = arcs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return arcs.join(least, "a")


def _signature(edges: DataFrame) -> tuple:
    """Changes when the edges do: their number and two sums, all combined before they leave a task."""
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.hash("b", "a").cast("long"))
    ).first()
    return tuple(row)


def components(edges: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """node, component (least node reachable) for every node that an edge between two nodes touches.

    Edges count in both directions; loops, repeats and edges with a null end are ignored. No edge, no row.
    """
    a, b = F.col(first), F.col(second)
    edges = settle(
        edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    )
    seen = _signature(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _point_to_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        known = _point_to_least(large)
        small = known.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            known.where("a > m").select("a", F.col("m").alias("b")))
        edges = settle(small.distinct())
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
