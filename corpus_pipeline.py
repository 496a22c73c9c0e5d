"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents
(the last: packed pieces). ``run`` writes each stage's rows as Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, langid, packing, simhash, substring
from lexmill.llm.common import drop, scratch, stage_at
from lexmill.session import ship

#: No stage but the last can be said in SQL: a fitted classifier and fingerprints' components come first.
ORACLE_SQL = None

#: Rows whose language is unknown, or surer by chance than this, are rejected.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised: no null, letterless or doubtful texts."""
    found = langid.predict(docs, langid.train(docs), keep=True)
    lang, score = found.columns[-2:]
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: the smallest doc_id, rows without doc_id last; among equals the first."""
    return simhash.without_near_duplicates(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that stand in several places; documents that lose all their words go."""
    found = substring.substring_dedup(docs, keep=True)
    words, gone = found.columns[-2:]
    changed = F.col(gone) > 0
    out = found.where((F.col(words) > F.col(gone)) | (F.col(words) == 0)).withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into token windows."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("substrings", substrings), ("decontaminate", leaks), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    ship(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, f in STAGES[:-1]:
        with scratch(spark):
            rows, path = stage_at(f(spark, docs, sf_dir), f"pipeline-{name}")
        drop(spark, before)
        docs, before = rows, [path]
    return STAGES[-1][1](spark, docs, sf_dir)
