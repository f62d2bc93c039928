"""A corpus pipeline of five stages; each takes all rows that its predecessor kept. Stages with Python steps bound the bytes of the batches that this session sends to its workers."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfgraph.llm import toxicity
from shelfgraph.llm.bpe import encode_documents
from shelfgraph.llm.common import bound_batches, settle
from shelfgraph.llm.decontaminate import drop_contaminated
from shelfgraph.llm.jaccard_join import drop_near_copies
from shelfgraph.llm.lsm_dedup import drop_copies


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the lexicon is learned from the labels of these documents."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id."""
    return drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8, the one with the smallest id."""
    bound_batches(spark)
    return drop_near_copies(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded text."""
    bound_batches(spark)
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), ("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("toxicity", reject_toxic), ("exact dedup", drop_exact_copies), ("near dedup", drop_near), ("decontamination", decontaminate), ("bpe", encode)]

#: A learned lexicon, a similarity join and a tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what a stage keeps is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs, name.replace(" ", "-"))
    return docs
