"""Connected components of a graph of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.storage import materialize


def _least(edges: DataFrame) -> DataFrame:
    """The smallest of each node ``a`` and its neighbours ``b``."""
    return edges.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties each node's larger neighbours to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.where("b > a").join(materialize(_least(both), "least"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Ties each node and its smaller neighbours to the smallest of them; ``a > b`` in all edges."""
    least = materialize(_least(edges), "least")
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` for every node that a link joins to another one; a component is its smallest node.

    Links may repeat, point either way or lead from a node to itself; a link with a null end counts for
    nothing. No links give no rows. Each step is a pre-aggregated minimum and a join, whatever the size of a
    component. The minima are written, so that adaptive execution can split their join at a node of many links, and
    so is what two steps in turn give; these are repeated until they change nothing.
    """
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & F.col("a").isNotNull() & (F.col("a") > F.col("b")))
    edges = materialize(edges.distinct(), "links")
    before, after = None, _state(edges)
    while before != after:
        edges = materialize(_small_star(_large_star(edges)), "links")
        before, after = after, _state(edges)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
