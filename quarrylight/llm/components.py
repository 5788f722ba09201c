"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _step(e: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """One large-star and one small-star step over edges (x, y) with x > y.

    Large-star hangs each x on the smallest neighbour of y.  Only nodes with a smaller neighbour have
    one other than themselves, so a root with a third of all nodes meets no row of ``low``; that table
    is written first, so that both sides of the join are exchanges, which Spark splits where they are
    skewed, or one is small enough for it to broadcast.
    """
    low = scratch.keep(name, e.groupBy("x").agg(F.min("y").alias("m")).withColumnRenamed("x", "lx"))
    large = e.join(low, F.col("y") == F.col("lx"), "left").select("x", F.coalesce("m", "y").alias("y"))
    least = large.groupBy("x").agg(F.min("y").alias("m"))
    hooks = large.join(least.withColumnRenamed("x", "lx"), F.col("x") == F.col("lx")).where("y > m")
    return hooks.select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.withColumnRenamed("m", "y")).distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root (the smallest node of its component) for every node that isn't itself the root.

    ``edges`` has columns x and y; loops and repeats are ignored.  Both joins have a row count in
    proportion to the edges; each step is written, so a lost executor costs one step.  The steps
    end when every edge joins a node to its root, which takes about the logarithm of the longest path.
    """
    e = edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    seen, turn = None, 0
    while True:
        e = scratch.keep(f"{name}-{turn}", e)
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y") % (1 << 31))).first()
        if turn:
            scratch.drop(f"{name}-{turn - 1}", f"{name}-low-{turn}")
        if mark == seen or mark[0] == 0:
            return e.select(F.col("x").alias("node"), F.col("y").alias("root"))
        seen, turn = mark, turn + 1
        e = _step(e, scratch, f"{name}-low-{turn}")
