"""Connected components of a graph held in DataFrames, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _least(edges: DataFrame) -> DataFrame:
    """u and the least of u and its neighbours, for edges held in one direction each."""
    return edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Neighbours that are larger than a node are linked to the node's least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (u long, v long); component is the least node reached.

    Nodes that are a component's least aren't listed. Null ends and loops are dropped; repeated edges
    count once. Every round cuts the lineage by a table in the shared folder.
    """
    edges = edges.where("u is not null and v is not null and u != v")
    edges = common.saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        edges = common.saved(_small_star(_large_star(edges)), "edges")
        last, mark = mark, _mark(edges)
        if last == mark:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
