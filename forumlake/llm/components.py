"""Connected components of an edge table by alternating large and small stars.

Every round is a table in the shared folder; nothing of it reaches the driver but two
numbers that tell whether the edges still change. Hubs are combined before the shuffle
(minimum by key) and their edges meet the minimum in a join that can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from forumlake.session import stage

ROUNDS = 40


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-star")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = stage(down.groupBy("u").agg(F.min("v").alias("m")), "small-star")
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (columns a, b: bigint); the root is its component's least node."""
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    for _ in range(ROUNDS):
        stars = stage(_large_star(edges).where("a <> b").distinct(), "stars")
        edges = stage(_small_star(stars).where("a <> b").distinct(), "stars")
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
