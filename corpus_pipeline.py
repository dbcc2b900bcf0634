"""Training-data pipeline over the documents table: five stages, each written as Parquet and read again.

Toxic documents go, one document of each near-duplicate class stays, benchmark passages are cut out, sources are mixed to
their weights, and the result is written as token shards in training order. The last stage returns the shard index, the
others the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import decontamination, mixing, simhash, token_output, toxicity
from ledgerspark.llm.common import table
from ledgerspark.session import materialise


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity cutoff. The classifier is fitted on the labelled ones among docs."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of similarity 0.8 or more on five-word shingles."""
    return simhash.deduplicate(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of a benchmark item; those that are mostly such passages go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated as their source's target asks for."""
    return mixing.draw(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Index of the token shards: one row per sequence with its slot, place and document."""
    return token_output.write(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", cut_benchmark_passages),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Classifier, fingerprints and tokenizer can't be stated in SQL; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents. An empty table passes through; no shard is written then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
