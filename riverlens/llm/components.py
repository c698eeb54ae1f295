"""Connected components of a distributed edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node sends its larger neighbours to the least node in its closed neighbourhood. The least
    nodes are written first: between two tables Spark splits the join where a node has very many
    neighbours, which it can't behind an aggregate."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node sends its smaller neighbours, and itself, to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return (
        edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    )


def _is_stars(edges: DataFrame) -> bool:
    """Every node has one larger end or is a centre, never both: then the centres are the least nodes."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("centre")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("centre").alias("centre")).where("up > 1 or up = 1 and centre = 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge table of longs; component is the least node reachable.

    Nodes that only have an edge to themselves, and edges with a null end, give no row. Each round is
    written to the shared folder; a round halves the depth of every tree, so the rounds grow with the
    logarithm of the longest path. Sums per node are made before each shuffle, and the joins that
    bring a node's least neighbour back are plain equi-joins, which AQE splits when a node is hot.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = cut(e.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct(), "edges")
    while not _is_stars(e):
        e = cut(_small_star(_large_star(e)).distinct(), "edges")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
