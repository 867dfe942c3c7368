"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import discard, written

#: A node is hot if it has more than HOT_LEAST edges and more than one in HOT_SHARE of all of them,
#: so there are at most 2 * HOT_SHARE hot nodes: their rows are joined by a broadcast, without a shuffle.
HOT_LEAST, HOT_SHARE = 500, 1000


def _with_least(rows: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """`rows` with their node's `least`; least(a, least, n) has a row for each node and its number of edges."""
    most = max(HOT_LEAST, n_edges // HOT_SHARE)
    marked = rows.join(F.broadcast(least.where(f"n > {most}").select("a", F.col("least").alias("_hot"))), "a", "left")
    others = marked.where("_hot is null").drop("_hot").join(least.where(f"n <= {most}").select("a", "least"), "a")
    return marked.where("_hot is not null").withColumnRenamed("_hot", "least").unionByName(others)


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Every neighbour above a node is joined to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"), F.count(F.lit(1)).alias("n"))
    return _with_least(both.where("b > a"), least, n_edges).select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """A node and its neighbours below it are joined to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(down, least, n_edges).where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b")))


def _all_stars(edges: DataFrame) -> bool:
    """Does every node have either one edge, upwards to its root, or only edges from below?"""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or (up = 1 and root = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of `edges` (a long, b long): root is the smallest node of its component.

    Each round is written to the shared folder, so lineage stays short, and replaces the one
    before; rounds grow with the logarithm of a component's size.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _all_stars(now):
        n_edges = now.count()
        wide = written(_large_star(now, n_edges).distinct(), "edges")
        before, now = now, written(_small_star(wide, n_edges).distinct(), "edges")
        discard(before, wide)
    return nodes.join(now, nodes.node == now.a, "left").select("node", F.coalesce("b", "node").alias("root"))
