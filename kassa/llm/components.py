"""Connected components of an edge table, by alternating large and small stars.

Every round is one shuffle per star on narrow rows and ends in a written table.  Edges of a hub
are rewritten one by one, so no task holds a neighbourhood; least neighbours are partial aggregates.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kassa.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b).  Large star: each node's greater neighbours move to its least one; small star: its lesser."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        moved = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        moved = edges.join(least, F.col("a") == F.col("u")).select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return moved.where("a > b").distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the least node reachable.

    ``edges``: two comparable columns, in any direction; loops and repeats are ignored.
    """
    x, y = edges.columns
    edges = edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where("a > b").distinct()
    edges = scratch.settle(edges, "edges")
    before = None
    while True:
        after = scratch.settle(_star(_star(edges, large=True), large=False), "stars")
        state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        scratch.drop(edges)
        edges = after
        if state == before:
            break
        before = state
    # a fixed point: every node points straight at its root
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
