"""Corpus pipeline: five stages over documents, each the whole work of one training-data operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import bpe_codec, decontamination, near_dedup, pii, toxicity
from geoloom.llm.common import load, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine, trained on the labelled ones, doesn't reject."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at five-word shingle similarities of 0.8 or more."""
    return near_dedup.drop_duplicates(docs, width=5, num=80, den=100)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the words of benchmark windows cut out."""
    return decontamination.remove_hits(docs, load(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return bpe_codec.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), cache=30_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("pii", redact_personal_data),
    ("bpe_codec", encode),
]

#: The trained and the hashed stages can't be put into SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
