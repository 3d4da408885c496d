"""A pipeline over a corpus of documents: toxicity, near-duplicates, benchmark passages, mixture and shards.

Each stage takes the rows that the one before kept, written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import decontamination, mixing, sharding, simhash, toxicity
from tracewright.llm.common import free_name, whole_row, written
from tracewright.llm.queries import MIX_SEED, MIX_SHARE, SHARDS, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score at least the threshold; the model learns from all labels."""
    score = free_name(docs, "toxicity")
    return toxicity.scored(docs, table(spark, sf_dir, "labels"), out=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item."""
    held = docs.select(whole_row(docs).alias("row"), "text")
    return decontamination.contamination(held, table(spark, sf_dir, "benchmark")).where("n_items = 0").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each leaf's share of the budget, each document once at most."""
    return mixing.mixture(docs, MIX_SHARE, 1, MIX_SEED)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard."""
    return sharding.shard_of(docs, "doc_id", sharding.regular_topology(SHARDS))


STAGES = [("toxicity", without_toxic), ("near duplicates", without_near_duplicates), ("benchmark decontamination", without_benchmark), ("mixing", mixed), ("sharding", sharded)]
#: The classifier and the fingerprints are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
