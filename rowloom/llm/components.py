"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_on_unique


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang the larger (or the other) neighbours of each node on its smallest neighbour."""
    if larger:
        rows = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        rows = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = rows.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = join_on_unique(rows, least, ["a"], "inner")
    if larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.where("a <> m").select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for each node of ``edges(a, b)``; ``component`` is the smallest node that it reaches.

    Loops and repeated edges are allowed, nulls are left out, and no edges give no rows.
    Each round writes its edges to the checkpoint folder; hubs are joined by broadcast, as
    few nodes can be heavy.  The rounds end when the edges no longer change.
    """
    now = cut(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(most_rounds):
        print_of = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if not print_of["n"] or (print_of["n"], print_of["s"]) == mark:
            break
        mark = (print_of["n"], print_of["s"])
        now = cut(_star(cut(_star(now, True)), False).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
