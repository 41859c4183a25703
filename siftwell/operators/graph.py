"""Components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import kept


def _stars(edges: DataFrame) -> bool:
    """Whether every vertex is a centre or has one: then nothing is left to do."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in links (a, b): root is the smallest id reachable.

    Alternating large-star and small-star steps: each is one exchange of narrow rows, a vertex of many
    neighbours is aggregated before the exchange, and the number of rounds is logarithmic. Every round ends
    in a checkpoint. Empty links give an empty result; loops and repeated links are harmless.
    """
    both = lambda e: e.select(F.col("a").alias("v"), F.col("b").alias("u")).union(e.select(F.col("b").alias("v"), F.col("a").alias("u")))
    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(edges):
        # (a table of its own: the join then has an exchange of its own, in which Spark can split a vertex of many edges)
        low = kept(both(edges).groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m")))
        # large star: the larger neighbours of v link to the least of v's neighbourhood
        large = edges.join(low, edges["b"] == low["v"]).select("a", F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the smaller neighbours of v, and v, link to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "v")
        small = large.join(low, large["a"] == low["v"]).select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("v").alias("a"), F.col("m").alias("b")))
        edges = kept(small.where("a <> b").distinct())
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root").union(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
