"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation and a join on node ids; no node's neighbours are gathered, so a
centre with any number of links stays spread over tasks (the minimum is partially aggregated,
the join back is left to the skew-join rule). Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (both.filter("b > a").join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return (r[0], r[1])


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) -> (node, root): every node that has a link, with the smallest
    node it reaches. NULL ends and self links are dropped, repeated edges count once; no edges
    give an empty result. Ends when a round changes nothing (about log2 of the longest chain).
    """
    e = written(edges.select("a", "b").dropna().filter("a <> b").distinct(), "edges")
    state = _state(e)
    while state[0]:
        e = written(_small_star(_large_star(e)), "edges")
        new = _state(e)
        if new == state:
            break
        state = new
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
