"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import stored

MAX_ROUNDS = 60  # each halves the depth at least; beyond 60 something is wrong, so it fails loudly


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (a, b) with a > b. Large: hang every larger neighbour on the smallest one known.

    Small: hang a node's smaller neighbours, and itself, on the smallest of them.
    """
    if large:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes without links are absent.

    ``links``: columns a and b, in any order, repeated or not; self-links do not count. Every round
    is written to the shared folder, so a lost executor repeats one round at most. No list of
    neighbours is ever built: hubs only meet in a minimum, summed up on the map side, and in a join.
    """
    tidy = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now, seen = stored(tidy, "links"), None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        now = stored(_star(stored(_star(now, True), "large-star"), False), "small-star")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
