"""The registered queries of this subpackage and, where SQL can say it, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontaminate, langid, licenses, lm, packing, phrases, pieces, simhash, substring, suffixes, token_counts, topk
from .oracle import ORACLE


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a fifth of its words edited."""
    return decontaminate.find_leaks(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in no 35-word window standing elsewhere too."""
    return substring.substring_dedup(_docs(spark, sf_dir)).drop("kept")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that lie in no 50-byte string of an earlier document."""
    return suffixes.suffix_dedup(_docs(spark, sf_dir)).drop("kept")


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and interpolated log probabilities of every document."""
    return lm.score_documents(_docs(spark, sf_dir))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document by diagonal voting, and the fixed phrases."""
    return licenses.scan(_docs(spark, sf_dir)).drop("matches")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every 20th vector among all others."""
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify(_docs(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count of every document."""
    return token_counts.count_tokens(_docs(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into 2048-token sequences, concatenated and cut."""
    return packing.pack(_docs(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language by their lowest-scoring cut."""
    return phrases.collocations(_docs(spark, sf_dir))


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document under the merge-type vocabulary, and what they decode to."""
    return pieces.digests(pieces.encode(_docs(spark, sf_dir)))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's centroid after five rounds, with its squared distance."""
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontaminate, op2_substring_dedup, op3_suffix_dedup, op4_lm_scores, op5_license_scan, op6_top_k, op7_simhash, op8_language_id, op9_token_counts, op10_packing, op11_collocations, op12_sentence_pieces, op13_centroids)}

__all__ = ["ORACLE", "QUERIES"]
