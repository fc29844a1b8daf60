"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, mixing, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of `documents` in all but the
last stage; `run` writes each stage as Parquet in the shared folder and rereads it as the next one's input. Texts go to
Python workers in small Arrow batches (see bounded_batches).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewin.llm import decontamination, mixing, sharding, simhash, toxicity
from tidewin.llm.support import bounded_batches, read, stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more for toxicity go; all labels teach, but none its own text."""
    bounded_batches(spark)  # for this stage and the next ones
    return toxicity.reject(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a five-word Jaccard similarity of 0.8 or more stays, the one with the
    smallest id (SimHash and its BK-trees name pairs first, prefixes and sketches what lies beyond their radius; all are
    verified exactly, see near_copies)."""
    return simhash.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 80 % of a benchmark item's words in tiles of five words or more go."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages are sampled to the target token shares, with no document repeated."""
    return mixing.sample(docs, mixing.languages(docs, read(spark, sf_dir, "labels")), mixing.TARGETS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard, and its position there."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", mix),
    ("sharding", shard),
]

#: The stages' models and searches are beyond SQL; the pipeline is tested against its parts instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}", "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
