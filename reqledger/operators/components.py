"""Connected components of a graph by large and small stars: each round is two aggregations and two joins over the edges, and a few rounds in the logarithm of the size suffice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.written import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the ends of the edges (a, b); component is the smallest node that can be reached. Loops name nodes without edges. Nothing of the graph is collected."""
    # A round that changes nothing leaves the number of edges and two sums over their hashes alike.
    marks = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))]
    before, pairs = None, written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(pairs.filter("a = b"))
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a")
        fresh = written(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = fresh.agg(*marks).first()
        discard(pairs)
        pairs = fresh
        if now == before:
            return pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
        before = now
