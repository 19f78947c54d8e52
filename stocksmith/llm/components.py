"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over (a, b) edges: neighbours are hung on the smallest of them.

    The minimum per node is checkpointed, so that the join reads two plain tables
    and Spark can split a node with very many neighbours."""
    spark = edges.sparkSession
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = checkpointed(spark, both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    hung = both.join(least, "a")
    if large:
        out = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b"))
    return checkpointed(spark, out.distinct())


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.shiftright(h, 32)), F.lit(0)), F.coalesce(F.sum(h.bitwiseAND(0xFFFFFFFF)), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the undirected edges (a, b): label is the smallest node that it can reach."""
    edges = checkpointed(edges.sparkSession, edges.select("a", "b").where("a <> b").distinct())
    before = None
    while (now := _state(edges)) != before:
        before = now
        edges = _star(_star(edges, True), False)
    # every node now hangs on its component's smallest one
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
