"""Connected components of an edge table, by alternating star operations.

In every round each node points to the least node it knows, and its other
neighbours are pointed there too: a grouping and an equi-join over the edges,
which adaptive execution splits where one node has very many.  The edges are written to the shared folder after each round; only their count
and a digest come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are pointed to the least of it and its neighbours."""
    e = _both(edges)
    least = e.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return e.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, are pointed to the least of them."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    least = e.groupBy("b").agg(F.min("a").alias("m"))
    j = e.join(least, "b")
    up = j.select(F.col("m").alias("a"), F.col("a").alias("b")).where(F.col("a") != F.col("b"))
    return up.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root): every node of the edges (long columns a, b) and the least
    node of its component."""
    state = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), tag)
    digest = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = digest(state)
    for _ in range(MAX_ROUNDS):
        state = written(_small_star(_large_star(state)), tag)
        now = digest(state)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return state.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        state.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
