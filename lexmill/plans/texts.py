"""Queries over text: extracted citations, record cites, quotations, paragraphs, sentences, visible text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import brief, extraction, quotes
from ..session import table
from ..sources import texts
from .registry import query


@query("""
SELECT o_orderkey, 4 AS start, 4 + length(CAST(o_custkey % 50 + 1 AS VARCHAR)) + 10 + length(CAST(o_orderkey % 3000 + 1 AS VARCHAR)) AS "end", CAST(o_custkey % 50 + 1 AS VARCHAR) || ' U.S.C. § ' || (o_orderkey % 3000 + 1) AS fragment FROM orders
""")
def cite_spans_usc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U.S. Code cites with exact spans."""
    t = F.concat(F.lit("See "), (F.col("o_custkey") % 50 + 1).cast("string"), F.lit(" U.S.C. § "), (F.col("o_orderkey") % 3000 + 1).cast("string"), F.lit(" there"))
    return extraction.extract(table(spark, sf_dir, "orders").select("o_orderkey", t.alias("text")), "text", ["o_orderkey"]).where("kind = 'us-code'").select("o_orderkey", "start", "end", "fragment")


@query("""
SELECT o_orderkey, 3 AS start, 3 + length(CAST(o_custkey AS VARCHAR)) + 6 + length(CAST(o_orderkey AS VARCHAR)) AS "end", 'reporter' AS kind FROM orders
""")
def cite_spans_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reporter cites with exact spans."""
    t = F.concat(F.lit("in "), F.col("o_custkey").cast("string"), F.lit(" U.S. "), F.col("o_orderkey").cast("string"), F.lit("."))
    return extraction.extract(table(spark, sf_dir, "orders").select("o_orderkey", t.alias("text")), "text", ["o_orderkey"]).select("o_orderkey", "start", "end", "kind")


@query("""
WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 900 + 1 AS VARCHAR) a, CAST(o_custkey % 900 + 1 AS VARCHAR) b FROM orders)
SELECT o_orderkey, 6 AS start, 'sections ' || a || ' and ' || b AS fragment FROM o UNION ALL SELECT o_orderkey, 6, 'sections ' || a FROM o UNION ALL SELECT o_orderkey, 6 + 9 + length(a) + 5, b FROM o
""")
def section_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinated sections: the list and its members."""
    t = F.concat(F.lit("Under sections "), (F.col("o_orderkey") % 900 + 1).cast("string"), F.lit(" and "), (F.col("o_custkey") % 900 + 1).cast("string"), F.lit(" it is so."))
    return extraction.extract(table(spark, sf_dir, "orders").select("o_orderkey", t.alias("text")), "text", ["o_orderkey"]).select("o_orderkey", "start", "fragment")


@query("SELECT o_orderkey, 'ECF No.' AS kw, CAST(o_orderkey % 90 + 1 AS VARCHAR) AS nums, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey % 40 + 1 AS VARCHAR) END AS pin FROM orders")
def record_cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Docket cites with their entries and pages."""
    k = F.col("o_orderkey")
    t = F.concat(F.lit("As pleaded, ECF No. "), (k % 90 + 1).cast("string"), F.when(k % 2 == 0, F.concat(F.lit(" at "), (F.col("o_custkey") % 40 + 1).cast("string"))).otherwise(""), F.lit(", so."))
    o = brief.record_cites(table(spark, sf_dir, "orders").select("o_orderkey", t.alias("text")), "text", ["o_orderkey"])
    return o.select("o_orderkey", F.regexp_extract("raw", r"^(.*?) [0-9]", 1).alias("kw"), F.array_join("entries", ",").alias("nums"), "pin")


@query("SELECT doc_id, len(q) AS n, list_sum(list_transform(q, lambda x: len(x) - 2)) AS chars FROM (SELECT doc_id, regexp_extract_all(text, '“[^”]{1,750}[^”]{0,750}”|\"[^\"\\n]{1,750}[^\"\\n]{0,750}\"') AS q FROM documents) WHERE len(q) > 0")
def quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotations in documents, of 1 to 1,500 characters."""
    q = quotes.quotations(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return q.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("quote")).alias("chars"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    text = lambda n: F.concat(F.lit("Page "), F.lit(n), F.lit(" of "), F.col("doc_id").cast("string"), F.lit(f" holds alpha{n} beta{n} gamma{n}"))
    return d.select(F.col("doc_id").alias("doc"), F.posexplode(F.array(text("one"), text("two"), text("three"))).alias("i", "text")).select("doc", (F.col("i") + 1).alias("page_number"), "text")


@query("""
SELECT doc_id AS quote_id, CASE doc_id % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'wrong-page' WHEN 2 THEN 'not-found' WHEN 3 THEN 'exact' ELSE 'exact' END AS verdict,
  CASE doc_id % 5 WHEN 0 THEN '2' WHEN 1 THEN '2' WHEN 2 THEN '' WHEN 3 THEN '1,2' ELSE '3' END AS found_on FROM documents
""")
def quote_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotations against the pages that they cite: right page, wrong page, nowhere, over a break, altered words."""
    k = F.col("doc_id") % 5
    q = F.when(k < 2, "Alphatwo  betatwo").when(k == 2, "alphatwo gammatwo").when(k == 3, "gammaone Page two").otherwise("[A]lphathree ... gammathr[ee]")
    rng = F.struct(F.lit(2).cast("long").alias("lo"), F.lit(2).cast("long").alias("hi"))
    pins = F.when(k == 1, F.array(F.struct(F.lit(1).cast("long").alias("lo"), F.lit(1).cast("long").alias("hi")))).when(k == 4, F.array().cast("array<struct<lo:bigint,hi:bigint>>")).otherwise(F.array(rng))
    quoted = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("quote_id"), F.col("doc_id").alias("doc"), q.alias("quote"), pins.alias("pins"))
    return quotes.verdicts(quoted, _pages(spark, sf_dir)).select("quote_id", "verdict", F.array_join("found_on", ",").alias("found_on"))


@query("""
SELECT doc_id, n AS number, CASE n WHEN 1 THEN '1. First of ' || doc_id || chr(10) WHEN 2 THEN '¶ 2. Second' || chr(10) || '  goes on' || chr(10) ELSE '3) Third' || chr(10) END AS body FROM documents, (VALUES (1), (2), (3)) t(n)
""")
def paragraph_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered paragraphs, the first of a number."""
    t = F.concat(F.lit("Head\n1. First of "), F.col("doc_id").cast("string"), F.lit("\n¶ 2. Second\n  goes on\n3) Third\n2. Again"))
    return quotes.paragraphs(table(spark, sf_dir, "documents").select("doc_id", t.alias("text")), "text", ["doc_id"])


@query()
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of conversations."""
    return quotes.sentences(table(spark, sf_dir, "conversations"), "text", ["conv_id", "turn"]).select("conv_id", "turn", "n", "start", "end")


@query()
def html_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader of a page would see."""
    return texts.with_visible_text(table(spark, sf_dir, "pages").select("page_id", "html"), "html").select("page_id", "visible")


@query("""
SELECT doc_id, CAST(length(left(text, CAST(doc_id % 300 AS INTEGER))) - length(replace(left(text, CAST(doc_id % 300 AS INTEGER)), chr(10), '')) + 1 AS INTEGER) AS line FROM documents
""")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line of an offset."""
    return table(spark, sf_dir, "documents").select("doc_id", S.line_of(F.col("text"), (F.col("doc_id") % 300).cast("int")).alias("line"))
