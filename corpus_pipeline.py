"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing, packing. Each stage takes what its predecessor kept.

Every stage but the last returns the columns it was given; the operators' docstrings say what becomes of nulls, repeats and empty tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqledger.llm import minhash, mixing, packing, secrets, toxicity
from reqledger.llm.shared import fold, materialize, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score CUT or more; the network learns from the labels of the other folds."""
    net = toxicity.train(docs.filter(fold() != 2), table(spark, sf_dir, "labels").filter(fold() != 2))
    return toxicity.score(docs, net, to="__toxicity").filter(F.col("__toxicity") < toxicity.CUT).drop("__toxicity")


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates."""
    return minhash.without_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of every secret; n_chars follows the text."""
    out = secrets.redact(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources, at most twice each, so that the sources come to their weights; none goes."""
    return mixing.mix(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity_stage), ("minhash_dedup", minhash_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: Learned scores and tokenizers have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
