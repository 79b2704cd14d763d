"""The opN_ queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, decontamination, license_scan, lm_scoring, near_dedup, pii, suffix_dedup, token_counts, topk_search, toxicity
from .common import load


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_corpus(load(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan_licenses(load(spark, sf_dir, "documents")))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode_decode(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.score_texts(docs, toxicity.fit(docs, load(spark, sf_dir, "labels"))))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(spark, sf_dir)


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(load(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_near_dedup, op3_decontamination, op4_lm_scoring, op5_license_scan, op6_bpe_codec, op7_toxicity, op8_pii, op9_topk_search, op10_suffix_dedup, pipeline)}
ORACLES: dict[str, str] = {
    "op5_license_scan": license_scan.oracle_sql(),
    "op9_topk_search": topk_search.oracle_sql(),
}
