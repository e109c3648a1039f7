"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulegrain.llm.common import dropped, written


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) to (node, component): the smallest node that links reach.

    Nodes without a link to another node are absent. Neighbours are never
    gathered: each round aggregates a minimum for each node and joins it back,
    so a node with very many links is split like any skewed join key. Rounds
    grow with the logarithm of the longest path.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    before = _mark(edges)
    while True:
        after = written(_stars(edges), "stars")
        dropped(edges)
        edges, mark = after, _mark(after)
        if mark == before:
            break
        before = mark
    top = edges.select(F.col("b").alias("a")).distinct()
    return edges.unionByName(top.select("a", F.col("a").alias("b"))).select(F.col("a").alias("node"), F.col("b").alias("component"))
