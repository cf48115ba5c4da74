"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregate, combined before its shuffle, and a join of the edges with one row a node. A node with very
many neighbours would bring all of them to one task in that join, so the edges of heavy nodes stay where they are
(common.skew_join). Nothing but the at most MOST_HEAVY heaviest nodes is collected and no pairs are made. Each step
ends in a table in the shared folder, and the one before is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, skew_join, written


def _met(edges: DataFrame, rows: int) -> DataFrame:
    """(a, b, m): each edge with the least neighbour of a."""
    return skew_join(edges, edges.groupBy("a").agg(F.min("b").alias("m")), "a", rows=rows)


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = _met(both, 2 * rows).where(F.col("b") > F.col("a"))
    return met.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    met = _met(edges, rows)
    moved = met.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(met.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node that edges (a, b) of longs touch; root is the component's least node."""
    oriented = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = written(oriented)
    mark = _mark(now)
    while mark[0]:
        half, half_path = written(_large_star(now, mark[0]))
        then, then_path = written(_small_star(half, mark[0]))
        for old in (path, half_path):
            remove(edges.sparkSession, old)
        now, path, before = then, then_path, mark
        mark = _mark(now)
        if mark == before:
            break
    # Stars now: every node but the roots has one edge, to its root.
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
