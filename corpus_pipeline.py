"""A corpus pipeline of five stages: each takes the documents its predecessor kept.

toxicity drops documents that the lexicon rejects; exact_dedup keeps one row of equal texts; near_dedup
keeps one row of each group of near duplicates (five-word shingles, similarity of 0.8 or more); mixing
repeats and drops documents so that sources meet their target weights; pieces encodes every document into
two sampled SentencePiece segmentations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dockett.llm import exact_dedup, mixing, near_forest, piece_sampling, toxicity
from dockett.llm.common import materialize, public_tokenizer, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_forest.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_sampling.sampled_pieces(docs, public_tokenizer("piece_bpe_32k.model"), k=2)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("pieces", encode)]

#: Neither the learned lexicon nor fingerprints or sampled segmentations can be put into SQL; the tests
#: compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
