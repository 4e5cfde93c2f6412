"""The corpus pipeline: stages over whole tables, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import bpe, exact_dedup, mixing, quality, simhash
from gleaner.llm.common import Workspace
from gleaner.llm.queries import tokenizer_path


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of texts whose five-word shingles have a similarity of 0.8 or more."""
    return simhash.keep_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none of them or up to three times, by shard and shuffled in it."""
    return mixing.shuffled(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, and a digest of what they decode to."""
    return bpe.encode_decode(docs, tokenizer_path(), ("n_tokens", "ids", "decoded_sha256"), ("doc_id", "lang", "source"))


STAGES = [("quality rules", drop_poor), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix_sources), ("encoding", encode)]

#: Seeded draws and tokenising cannot be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = ws.save(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
