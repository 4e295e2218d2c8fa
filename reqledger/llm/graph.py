"""Connected components by alternating large-star and small-star steps on a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def _step(links: DataFrame, large: bool) -> DataFrame:
    """links(a, b) with a > b. Each node hands the least node it knows to its larger neighbours (large) or to all its smaller ones (small)."""
    both = links.select("a", "b")
    if large:
        both = both.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written, so that both sides of the join are plain exchanges that adaptive execution can split at a hot node.
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    moved = both.join(least, "a")
    if large:
        out = moved.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    out = materialize(out.filter("a <> b").distinct(), "links")
    discard(least)
    return out


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every node of links(a, b); component is the least node reachable. Links may repeat and go either way.

    Every step only joins and aggregates; the driver compares two checksums of the links, nothing more."""
    now = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    seen = None
    while True:
        wide = _step(now, True)
        discard(now)
        now = _step(wide, False)
        discard(wide)
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        seen = sums
