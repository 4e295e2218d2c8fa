"""Temperature mixing of sources.

Source shares of tokens (words of whole texts) are raised to an exponent and normalised. The exponent is bisected, in
sections of a grid that one aggregate over the source table evaluates: the least one, from 0 (all alike) up to MAX_EXPONENT, whose weights
have no more than a target entropy (nats), and then, between it and 1 (as they are), the least by which no source repeats more often than
a limit. A target that no such exponent meets, or only one that breaks the limit, is an error. A budget of tokens turns weights into quotas, and a quota into whole
passes over the source plus part of one. Documents fall by hash into blocks of bounded size; each pass orders the
blocks, and the documents of a block, by a seeded permutation. The part pass takes whole blocks in that order and, of
the block where the quota ends, the documents in its order up to the quota. No row of documents is shuffled: the
plan has a row for each block, at most a million and one for each source.

budget "keep" is the least budget that takes every document of every source at least once. A null source is a source
of its own; null text has no tokens. Rows equal in id and text share their fate. Sources without tokens pass once. An
empty table gives an empty result. Added columns replace input columns of their names, in any case. Jobs run while the result is built."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import column, discard, materialize, packed, table, unpacked

BLOCK_TOKENS, MAX_BLOCKS, SEED = 1 << 16, 1_000_000, 7
GRID, ROUNDS = 16, 5
#: Shares to this power leave nearly all to the largest source.
MAX_EXPONENT = 64.0
MAX_REPEAT = 2.0
#: Up to so many sources (one short row each), their table is broadcast.
BROADCAST_SOURCES = 100_000


ADDED = ("copy", "block", "block_order", "place", "weight", "exponent")


def _keys(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    return docs.select(packed(docs, *ADDED), column(text_col).alias("text"), F.coalesce(F.concat(F.lit("s"), column(source_col).cast("string")), F.lit("null")).alias("source"), F.xxhash64(F.lit(seed), column(id_col), column(text_col)).alias("hash"))


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _rate(share: Column, exponent: float, z: float, scale: float) -> Column:
    """Passes over a source: quota / own tokens."""
    return F.pow(share, F.lit(exponent - 1)) * scale / z


def exponent_for(sources: DataFrame, target_entropy: float | None, max_repeat: float | None, budget: str | int) -> tuple[float, float, float]:
    """(exponent, sum of powered shares, budget / all tokens). sources(source, t): t > 0. The driver gets one row of sums a round."""
    total, most = sources.agg(F.sum("t"), F.max("t")).first()
    share = F.col("t") / F.lit(float(total))

    def evaluate(grid: list[float]) -> list[tuple[float, float, float]]:
        cells = [c for e in grid for c in (F.sum(F.pow(share, F.lit(e))), F.sum(F.pow(share, F.lit(e)) * e * F.ln(share)), F.max(F.pow(share, F.lit(e - 1))), F.min(F.pow(share, F.lit(e - 1))))]
        row = sources.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first()
        out = []
        for i in range(len(grid)):
            z, power_log, high, low = row[4 * i : 4 * i + 4]
            scale = (z / low if low > 0 else math.inf) if budget == "keep" else float(budget) / total
            out.append((math.log(z) - power_log / z, high * scale / z, scale))
        return out

    def least(low: float, high: float, met) -> float:
        """The least exponent from low to high that meets a condition which, once met, stays so."""
        if met(*evaluate([low])[0]):
            return low
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
            at = min((i for i, x in enumerate(evaluate(grid)) if met(*x)), default=GRID)
            low, high = grid[max(0, at - 1)], grid[at]
        return high

    high = 1.0 if target_entropy is None and max_repeat is None else 0.0
    if target_entropy is not None:
        flat, peaked = (x[0] for x in evaluate([0.0, MAX_EXPONENT]))
        if not peaked - 1e-6 <= target_entropy <= flat + 1e-6:
            raise ValueError(f"no exponent from 0 to {MAX_EXPONENT:g} gives an entropy of {target_entropy}: these sources reach {peaked} to {flat}")
        at_most = next((e for e in (1.0, 4.0, 16.0) if evaluate([e])[0][0] <= target_entropy), MAX_EXPONENT)
        high = least(0.0, at_most, lambda entropy, repeat, scale: entropy <= target_entropy)
    if max_repeat is not None:
        if high < 1:
            high = least(high, 1.0, lambda entropy, repeat, scale: repeat <= max_repeat)
        if evaluate([high])[0][1] > max_repeat + 1e-6:
            raise ValueError(f"a source would repeat more than {max_repeat} times at exponent {high}")
    z = sources.agg(F.sum(F.pow(share, F.lit(high)))).first()[0]
    return high, z, evaluate([high])[0][2]


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", target_entropy: float | None = None, max_repeat: float | None = MAX_REPEAT, budget: str | int = "keep", block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """docs, each row as often as the mix takes it, with copy (the pass), block, block_order and place (by which a pass orders its blocks, and the documents of a block), weight (of the source) and exponent."""
    keyed = _keys(docs, id_col, source_col, text_col, seed)
    sized = materialize(keyed.select("source", "hash", tokens(F.col("text")).alias("tokens")), "mix-sizes")
    sources = materialize(sized.groupBy("source").agg(F.sum("tokens").alias("t")), "mix-sources")
    live = sources.filter("t > 0")
    total = live.agg(F.sum("t")).first()[0] or 0
    exponent, z, scale = exponent_for(live, target_entropy, max_repeat, budget) if total else (1.0, 1.0, 1.0)
    share = F.col("t") / F.lit(float(total or 1))
    rate = F.when(F.col("t") > 0, _rate(share, exponent, z, scale)).otherwise(1.0)
    # A pass that lacks less than a millionth is whole: the exponent is known to about that.
    passes = F.floor(rate + 1e-6)
    size = max(block_tokens, total // MAX_BLOCKS)
    plan = sources.select(
        "source", passes.cast("int").alias("passes"), F.greatest(F.lit(0.0), (rate - passes) * F.col("t")).alias("part"),
        F.when(F.col("t") > 0, F.pow(share, F.lit(exponent)) / z).otherwise(0.0).alias("weight"), F.ceil(F.greatest(F.col("t"), F.lit(1)) / size).alias("blocks"),
    )
    placed = sized.join(plan.select("source", "blocks"), "source").withColumn("block", F.pmod(F.col("hash"), F.col("blocks")))
    blocks = placed.groupBy("source", "block").agg(F.sum("tokens").alias("size"))
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed), F.col("passes"), F.col("source"), F.col("block")), "block")
    blocks = blocks.join(plan, "source").withColumn("rest", F.col("part") - (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")))
    blocks = materialize(blocks, "mix-blocks")
    # The block where a quota ends: its documents in hash order, up to the quota.
    edge = placed.join(blocks.filter("rest > 0 and rest < size").select("source", "block", "rest"), ["source", "block"])
    inner = Window.partitionBy("source", "block").orderBy(_place(seed))
    run = edge.withColumn("run", F.sum("tokens").over(inner.rangeBetween(Window.unboundedPreceding, Window.currentRow))).filter("run <= rest")
    cuts = run.groupBy("source", "block").agg(F.max(_place(seed)).alias("cut"))
    plan = materialize(blocks.join(cuts, ["source", "block"], "left"), "mix-plan")
    for t in (sized, sources, blocks):
        discard(t)
    # Both sides of the join on source and block; the plan is small, so Spark broadcasts it where its size allows.
    where = plan.select("source", F.col("block"), "passes", "rest", "size", "cut", "weight", "blocks")
    per_source = plan.groupBy("source").agg(F.first("blocks").alias("n"))
    if plan.select("source").distinct().count() <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)
    rows = keyed.join(per_source, "source").withColumn("block", F.pmod(F.col("hash"), F.col("n"))).join(where, ["source", "block"])
    more = ((F.col("rest") >= F.col("size")) & (F.col("rest") > 0)) | F.coalesce(_place(seed) <= F.col("cut"), F.lit(False))
    copies = F.col("passes") + more.cast("int")
    out = rows.withColumn("copies", copies).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return out.select(
        *unpacked(docs, *ADDED), F.col("copy").cast("int").alias("copy"), F.col("block").alias("block"),
        F.xxhash64(F.lit(seed), F.col("copy"), F.col("source"), F.col("block")).alias("block_order"), _place(seed).alias("place"), F.col("weight").alias("weight"), F.lit(exponent).alias("exponent"),
    )


def _place(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit("place"), F.col("hash"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).drop("text")
