"""Connected components of a graph of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import stash


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id of the links (a, b): root is the least id of its component.

    Large star: each node passes its larger neighbours on to its least neighbour. Small star: each node passes its
    smaller neighbours, itself included, on to the least of them. Rounds go on until no link changes; their number is
    logarithmic in the longest path. Each round is checkpointed, so that lost executors cost one round.
    """
    edges = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        nxt = large.join(small, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        edges = stash(nxt)
        mark, old = _mark(edges), mark
        if mark == old:
            break
    roots = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple[int, ...]:
    """Number of links and a sum over them, which tell whether a round changed any."""
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("x")).first()
    return int(r["n"]), int(r["x"] or 0)
