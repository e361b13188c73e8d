"""Connected components of an edge table, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import dropped, staged


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one root, which has none itself."""
    n = edges.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a").alias("a")).first()
    return n["n"] == n["a"] and edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b); root is the smallest node that a node reaches. A staged table.

    Alternating large-star and small-star rounds: every node hands its smallest neighbour first to
    its larger ones, then to its smaller ones. Minima are aggregated before the shuffle and joined back,
    so a node with very many neighbours is no single group; the rounds grow with the logarithm of
    the longest chain. Each round is a written table, which goes when the next one is there.
    """
    edges = staged(_canonical(edges), "edges")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(_canonical(large), "edges")
        low = staged(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(low, "a").select("a", "m", "b")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        after = staged(_canonical(small), "edges")
        dropped(edges, least, large, low)
        edges = after
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    out = staged(roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "components")
    dropped(edges)
    return out
