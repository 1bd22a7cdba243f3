"""Connected components of a distributed graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semaspan.session import stored


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component, for each node of `edges` (a, b) but the roots.

    No node gathers its neighbours: a star is a minimum by node, folded before the shuffle, joined back.
    Each round is written to the shared folder, so lineage stays short; the rounds grow with the logarithm
    of the nodes, and the loop ends when a round changes nothing.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b")).unionByName(
            least.select("a", F.col("root").alias("b"))
        )
        edges = stored(small.filter("a <> b").distinct())
        now = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
