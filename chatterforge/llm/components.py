"""Connected components of an undirected graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterforge.llm.common import materialize


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each larger end has one edge and is no smaller end: then every component hangs on its smallest node."""
    shared = edges.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("b")
    inner = edges.join(edges.select(F.col("b").alias("a")), "a", "left_semi").select(F.col("a").alias("b"))
    return shared.unionByName(inner).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u").join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` for every node that has an edge; component is its smallest node.

    Edges may repeat, point either way and join a node with itself; a null end
    drops the edge.  An empty edge table gives an empty result.  Rounds grow with
    the logarithm of a component's width; each is two shuffles of the remaining
    edges, aggregated before they move, and is checkpointed to the shared folder.
    """
    pairs = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s is not null and d is not null")
    pairs = materialize(pairs.select(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")).distinct())
    loops = pairs.where("a = b").select(F.col("a").alias("node"))
    now = pairs.where("a <> b")
    while not _is_forest_of_stars(now):
        now = materialize(_small_star(_large_star(now)))
    starred = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    found = starred.unionByName(roots)
    alone = loops.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(alone)
