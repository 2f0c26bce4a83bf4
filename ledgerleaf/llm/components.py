"""Connected components by alternating large and small stars, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Rounds after which something must be wrong: they grow with the logarithm of a component.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every neighbour above a node moves to the least of its neighbourhood."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return common.hot_join(both.where("v > u"), least, ["u"], 2 * total).select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """A node and its neighbours below move to the least of them (a < b holds)."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = common.hot_join(edges, least, ["b"], total).select(F.col("m").alias("x"), F.col("a").alias("y")).where("x <> y")
    return moved.union(least.select("m", "b")).toDF("a", "b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of an edge
    but the roots.  edges: two columns of longs.

    Null and equal ends make no edge; repeated edges count once; without edges the
    result is empty.  Groups are only aggregated and joined, never gathered, and nodes
    with very many neighbours are joined apart (common.hot_join); each half of a round is
    written to the shared folder."""
    a, b = edges.columns
    edges = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    edges = common.stored(edges, "edges")
    before = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        large = common.stored(_large_star(edges, before[0]), "edges")
        edges = common.stored(_small_star(large, before[0]), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
