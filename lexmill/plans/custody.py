"""Queries over registered files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import custody
from ..session import table
from .registry import query

_PATH = "concat(source, '/', CASE doc_id % 5 WHEN 0 THEN 'Filings/' WHEN 1 THEN 'evidence/' WHEN 2 THEN 'media/' ELSE '' END, 'd', doc_id, CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.eml' ELSE '.bin' END)"
_KIND = "CASE doc_id % 5 WHEN 0 THEN 'filing' WHEN 1 THEN 'evidence' WHEN 2 THEN 'media' ELSE CASE doc_id % 3 WHEN 0 THEN 'filing' WHEN 1 THEN 'correspondence' ELSE 'other' END END"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_PATH).alias("rel_path"), F.sha2("text", 256).alias("sha256"))


@query(f"""
WITH f AS (SELECT doc_id, {_PATH} AS rel_path, sha256(text) AS sha256, {_KIND} AS kind FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY rel_path) AS n FROM f)
SELECT kind, CASE WHEN n = 1 THEN 'added' ELSE 'skipped' END AS outcome, count(*) AS files FROM r GROUP BY 1, 2
""")
def custody_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files registered once for each hash, by kind and outcome."""
    return custody.register(_files(spark, sf_dir)).groupBy("kind", "outcome").agg(F.count("*").alias("files"))


@query("""
WITH f AS (SELECT 'p' || (o_custkey % 500) AS p, 'h' || (o_orderkey % 700) AS h, o_orderkey AS k FROM orders), d AS (SELECT DISTINCT p, h FROM f),
a AS (SELECT p, min(h) AS h FROM d GROUP BY 1), b AS (SELECT min(p) AS p, h FROM a GROUP BY h)
SELECT p AS rel_path, h AS sha256, count(*) AS n, count(*) FILTER (WHERE outcome = 'added') AS added FROM (
  SELECT f.p, f.h, CASE WHEN b.p IS NOT NULL AND row_number() OVER (PARTITION BY f.p, f.h ORDER BY k) = 1 THEN 'added' ELSE 'skipped' END AS outcome FROM f LEFT JOIN b ON f.p = b.p AND f.h = b.h) GROUP BY 1, 2
""")
def custody_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch in which paths come with several hashes and hashes with several paths: each is added once."""
    f = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), (F.col("o_custkey") % 500).cast("string")).alias("rel_path"), F.concat(F.lit("h"), (F.col("o_orderkey") % 700).cast("string")).alias("sha256"))
    return custody.register(f).groupBy("rel_path", "sha256").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "added").alias("added"))


@query("""
SELECT CASE WHEN doc_id % 17 = 1 THEN 'MISSING' WHEN doc_id % 17 = 2 THEN 'CHANGED' ELSE 'ok' END AS verdict, count(*) AS files
FROM documents GROUP BY 1
""")
def custody_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored hashes against a copy in which some files are gone and some changed."""
    stored = _files(spark, sf_dir)
    found = table(spark, sf_dir, "documents").where("doc_id % 17 <> 1").select(
        F.expr(_PATH).alias("rel_path"), F.sha2(F.when(F.col("doc_id") % 17 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256")
    )
    return custody.verify(stored, found).groupBy("verdict").agg(F.count("*").alias("files"))


@query(f"""
WITH f AS (SELECT doc_id, {_PATH} AS rel_path, sha256(text) AS sha256 FROM documents),
s AS (SELECT rel_path, sha256 FROM f WHERE doc_id % 3 <> 0)
SELECT f.doc_id, coalesce(a.rel_path, b.rel_path) AS recorded
FROM f LEFT JOIN s a ON f.rel_path = a.rel_path LEFT JOIN (SELECT sha256, min(rel_path) AS rel_path FROM s GROUP BY 1) b ON f.sha256 = b.sha256
""")
def recorded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name that the record knows a file by."""
    files = _files(spark, sf_dir)
    return custody.recorded_name(files, files.where("doc_id % 3 <> 0").select("rel_path", "sha256")).select("doc_id", "recorded")


@query("SELECT count(*) AS files, count(*) FILTER (WHERE doc_id % 13 NOT IN (4, 5)) AS agreeing FROM documents")
def parent_hash_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-way agreement of hashes between a case, its parent and the files."""
    f = _files(spark, sf_dir)
    parent = f.where("doc_id % 13 <> 4").select("rel_path", "sha256")
    scan = f.select("rel_path", F.when(F.col("doc_id") % 13 == 5, F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256"))
    # A reversed hash could equal itself only as a palindrome of 64 digits.
    return custody.parent_agreement(f, parent, scan).agg(F.count("*").alias("files"), F.count_if("agrees").alias("agreeing"))


@query()
def case_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given tables' own files as a case's: path, size and hash, read where they lie."""
    from ..sources.texts import case_files

    return case_files(spark, sf_dir).select("rel_path", "bytes", "sha256")


@query("""
SELECT doc_id, doc_id % 4 NOT IN (1, 2) AS safe FROM documents
""")
def path_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which composed paths are relative and never go up."""
    path = F.expr("concat(CASE doc_id % 4 WHEN 1 THEN '/' WHEN 2 THEN 'a/../' ELSE 'b/' END, source, '/', doc_id)")
    return table(spark, sf_dir, "documents").select("doc_id", S.safe_path(path).alias("safe"))


@query("""
WITH d AS (SELECT doc_id, string_split_regex(text, '\\f') AS p FROM
  (SELECT d.doc_id, concat(d.text, chr(12), coalesce(b.text, ''), CASE WHEN d.doc_id % 2 = 0 THEN chr(12) ELSE '' END) AS text FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % 40)),
e AS (SELECT doc_id, CASE WHEN trim(p[len(p)], ' ' || chr(9) || chr(10) || chr(13)) = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM d)
SELECT doc_id, CAST(i AS INTEGER) AS page_number, CAST(length(p[i]) AS INTEGER) AS chars FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM e)
""")
def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at form feeds; a blank last page is dropped."""
    from ..sources.texts import split_pages

    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("b"))
    full = d.join(b, b.item_id == d.doc_id % 40, "left").select("doc_id", F.concat("text", F.lit("\f"), F.coalesce("b", F.lit("")), F.when(F.col("doc_id") % 2 == 0, "\f").otherwise("")).alias("text"))
    return split_pages(full, "text").select("doc_id", "page_number", F.length("page").alias("chars"))


@query("""
WITH u AS (SELECT page_id, trim(url) AS u FROM pages),
p AS (SELECT page_id, regexp_extract(u, '(?i)^(https?)://([^/?#]+)([^?#]*)(\\?[^#]*)?', 1) s, regexp_extract(u, '(?i)^(https?)://([^/?#]+)([^?#]*)(\\?[^#]*)?', 2) h,
  regexp_replace(regexp_extract(u, '(?i)^(https?)://([^/?#]+)([^?#]*)(\\?[^#]*)?', 3), '/+$', '') t, regexp_extract(u, '(?i)^(https?)://([^/?#]+)([^?#]*)(\\?[^#]*)?', 4) q FROM u),
c AS (SELECT page_id, CASE WHEN h <> '' THEN lower(s) || '://' || lower(h) || CASE WHEN t = '' THEN '/' ELSE t END || CASE WHEN q = '?' THEN '' ELSE q END END AS url FROM p)
SELECT page_id, url, 'or_' || left(sha256(url), 12) AS id FROM c
""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by canonical address and stable id."""
    return table(spark, sf_dir, "pages").select("page_id", S.canonical_url(F.col("url")).alias("url")).withColumn("id", S.stable_id(F.col("url")))
