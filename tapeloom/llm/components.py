"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tapeloom.sources import written


def _mark(edges: DataFrame) -> tuple:
    """A number that changes with the set of edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Every node hands its smallest neighbour to its larger (or to its other smaller) neighbours.

    The minimum of a node is aggregated before the shuffle, so a node with very many neighbours sends
    one row per task; the join back is on a side with one row per node.
    """
    ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if larger else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, for every node of the edges (``a``, ``b``).

    Null ends and loops are left out. Each round is written to the shared folder, which cuts the lineage.
    """
    held = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _mark(held)
    while seen[0]:
        held = written(_star(_star(held, True), False), "stars")
        now = _mark(held)
        if now == seen:
            break
        seen = now
    return held.select(F.col("a").alias("node"), F.col("b").alias("component"))
