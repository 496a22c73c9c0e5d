"""Queries over labelled spans, bound cites and units, with truth computed from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binding as B
from ..operators import scoring as X
from ..session import table
from .registry import query


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold: one span for each order. Predictions: right for most keys, shifted, too long, doubled or missing for others."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        k.alias("item_id"), F.concat(F.lit("d"), (k % 100).cast("string")).alias("doc"), F.when(k % 2 == 0, "A").otherwise("B").alias("set"), (k * 10).alias("start"), (k * 10 + 5).alias("end"), F.lpad(k.cast("string"), 5, "0").alias("text"), (k % 10).alias("m")
    )
    gold = o.select("set", "item_id", "doc", "start", "end", "text")
    p = o.where("m <> 1").withColumn("copies", F.when(F.col("m") == 4, 2).otherwise(1)).withColumn("c", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    preds = p.select(
        (F.col("item_id") * 10 + F.col("c")).alias("pred_id"), "doc", F.when(F.col("m") == 3, F.col("start") - 4).otherwise(F.col("start")).alias("start"), F.when(F.col("m") == 2, F.col("end") + 1).otherwise(F.col("end")).alias("end"),
        F.when(F.col("m") == 2, F.concat("text", F.lit("."))).when(F.col("m") == 3, F.concat(F.lit("See "), "text")).otherwise(F.col("text")).alias("text"), F.when(F.col("m") == 5, F.reverse("text")).otherwise(F.col("text")).alias("normalized"),
    )
    return gold, preds


@query("SELECT o_orderkey AS item_id, o_orderkey % 10 NOT IN (1, 2, 3) AS matched FROM orders")
def span_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold spans and whether a prediction has taken each."""
    return X.match(*_spans(spark, sf_dir)).select("item_id", "matched")


@query("SELECT o_orderkey * 10 + CASE o_orderkey % 10 WHEN 4 THEN 2 ELSE 1 END AS pred_id FROM orders WHERE o_orderkey % 10 IN (2, 3, 4)")
def span_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions left over."""
    return X.false_positives(*_spans(spark, sf_dir)).select("pred_id")


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS set, count(*) AS gold, count(*) FILTER (WHERE o_orderkey % 10 NOT IN (1, 2, 3)) AS found, round(count(*) FILTER (WHERE o_orderkey % 10 NOT IN (1, 2, 3)) / count(*), 4) AS recall FROM orders GROUP BY 1")
def recall_by_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of each gold set."""
    return X.recall(*_spans(spark, sf_dir))


@query("SELECT o_orderkey AS item_id, lpad(CAST(o_orderkey AS VARCHAR), 5, '0') || '.' AS predicted FROM orders WHERE o_orderkey % 10 = 2")
def span_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misses by a trailing character or two."""
    gold, preds = _spans(spark, sf_dir)
    misses = X.match(gold, preds).where("not matched").select(*gold.columns)
    return X.hygiene(misses, preds).select("item_id", "predicted")


@query("""
WITH g AS (SELECT o_orderkey AS k, 'd' || (o_orderkey % 100) AS doc, lpad(CAST(o_orderkey AS VARCHAR), 5, '0') AS t FROM orders),
p AS (SELECT k * 10 + c AS pred_id, k, doc, CASE k % 10 WHEN 2 THEN t || '.' WHEN 3 THEN 'See ' || t ELSE t END AS t FROM g, (VALUES (1), (2)) v(c) WHERE k % 10 <> 1 AND (c = 1 OR k % 10 = 4))
SELECT pred_id, min(g.k) AS item_id FROM p JOIN g ON p.doc = g.doc AND contains(p.t, g.t) WHERE NOT (p.k = g.k AND p.k % 10 NOT IN (2, 3)) GROUP BY 1
""")
def span_pollution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that hold a gold text with something round it."""
    return X.pollution(*_spans(spark, sf_dir))


@query("SELECT o_orderkey AS item_id FROM orders WHERE o_orderkey % 10 = 5 AND lpad(CAST(o_orderkey AS VARCHAR), 5, '0') <> reverse(lpad(CAST(o_orderkey AS VARCHAR), 5, '0'))")
def norm_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched pairs whose normalised text differs."""
    return X.norm_mismatch(*_spans(spark, sf_dir)).select("item_id")


@query("""
WITH g AS (SELECT doc_id, text, substr(text, CAST(doc_id % 50 + 1 AS INTEGER), 20) AS t FROM documents)
SELECT doc_id AS item_id, CASE WHEN t <> '' THEN CAST(strpos(text, t) - 1 AS INTEGER) END AS start, coalesce(t, '') = '' AS missing FROM g
""")
def gold_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First places of quoted strings; texts too short to be quoted miss."""
    d = table(spark, sf_dir, "documents")
    gold = d.select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("doc"), F.expr("substring(text, cast(doc_id % 50 + 1 as int), 20)").alias("text"))
    return X.gold_offsets(gold, d.select(F.col("doc_id").alias("doc"), "text")).select("item_id", "start", "missing")


def _cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as cites in order: every third names a full key, the others are short forms."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("draft"), e.alias("place"), (e % 7).alias("num"), F.when(e % 3 == 0, e).alias("full_key"), (e % 2).alias("flow"), (F.floor(e / 40)).alias("unit"))


@query("""
WITH c AS (SELECT user_id AS draft, event_id AS place, event_id % 7 AS num, CASE WHEN event_id % 3 = 0 THEN event_id END AS f FROM events)
SELECT place, coalesce(f, max(f) OVER (PARTITION BY draft, num ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS bound FROM c
""")
def bind_latest_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare rules bound to the latest earlier full cite."""
    return B.bind_latest(_cites(spark, sf_dir), "draft", "num", "full_key", ["place"]).select("place", "bound")


@query("""
WITH c AS (SELECT user_id AS draft, event_id AS place, event_id % 7 AS num, CASE WHEN event_id % 3 = 0 THEN event_id END AS f FROM events)
SELECT place, coalesce(f, min(f) OVER (PARTITION BY draft, num ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CASE WHEN count(f) OVER (PARTITION BY draft, num) = 1 THEN max(f) OVER (PARTITION BY draft, num) END) AS bound FROM c
""")
def bind_first_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case short forms bound to the first full cite, else to the only one."""
    return B.bind_first(_cites(spark, sf_dir), "draft", "num", "full_key", ["place"]).select("place", "bound")


@query("""
WITH c AS (SELECT user_id AS draft, event_id AS place, event_id % 2 AS flow, CASE WHEN event_id % 3 = 0 THEN event_id END AS t, event_id // 40 AS unit FROM events),
a AS (SELECT *, max(t) OVER (PARTITION BY draft, flow ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ante FROM c),
m AS (SELECT draft, unit, count(DISTINCT t) > 1 AS many FROM c WHERE t IS NOT NULL GROUP BY 1, 2)
SELECT place, CASE WHEN t IS NULL THEN ante END AS antecedent, t IS NULL AND coalesce(many, false) AS ambiguous FROM a LEFT JOIN m ON m.draft = a.draft AND m.unit = ante // 40
""")
def id_antecedent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each 'Id.' stands for, by flow, and whether that is ambiguous."""
    c = _cites(spark, sf_dir)
    return B.id_antecedents(c, "draft", "flow", ["place"], F.col("full_key").isNull(), "full_key", "unit").select("place", "antecedent", "ambiguous")


@query("""
WITH q AS (SELECT l_orderkey AS u, l_linenumber AS n, l_linenumber * 100 AS a, l_linenumber * 100 + 50 AS b FROM lineitem WHERE l_linenumber % 2 = 0),
c AS (SELECT l_orderkey AS u, l_linenumber * 100 + 60 AS s, l_partkey AS key FROM lineitem WHERE l_linenumber % 3 = 0)
SELECT q.u, q.n, q.a AS q_start, coalesce(arg_min(c.key, c.s) FILTER (WHERE c.s >= q.b), arg_max(c.key, c.s) FILTER (WHERE c.s < q.a)) AS cite FROM (SELECT DISTINCT * FROM q) q LEFT JOIN (SELECT u, s, max(key) AS key FROM c GROUP BY 1, 2) c ON c.u = q.u GROUP BY 1, 2, 3
""")
def quote_nearest_cite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quotation's cite: the next in its unit, else the one before."""
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    q = li.where(n % 2 == 0).select(F.col("l_orderkey").alias("u"), n.alias("n"), (n * 100).alias("q_start"), (n * 100 + 50).alias("q_end")).distinct()
    c = li.where(n % 3 == 0).groupBy(F.col("l_orderkey").alias("u"), (n * 100 + 60).alias("start")).agg(F.max("l_partkey").alias("key"))
    return B.quote_cites(q, c, ["u"]).select("u", "n", "q_start", "cite")


@query("""
WITH u AS (SELECT conv_id, turn, turn * 10 AS s, turn * 10 + 9 AS e, role = 'assistant' AND turn % 3 = 1 AS lone FROM conversations),
w AS (SELECT *, greatest(sum(CASE WHEN lone THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY s), 1) AS unit_no FROM u)
SELECT conv_id, CAST(unit_no AS BIGINT) AS unit_no, min(s) AS start, max(e) AS "end", count(*) AS parts FROM w GROUP BY 1, 2
""")
def merge_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation-only sentences joined to the unit before."""
    t = F.col("turn")
    u = table(spark, sf_dir, "conversations").select("conv_id", (t * 10).alias("s"), (t * 10 + 9).alias("e"), ((F.col("role") == "assistant") & (t % 3 == 1)).alias("lone"))
    return B.merge_units(u, ["conv_id"], "s", "e", "lone")


@query("""
WITH u AS (SELECT conv_id, turn, turn % 4 = 0 AS f, turn % 4 = 2 AS i, turn % 5 = 1 AS touched FROM conversations),
r AS (SELECT *, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM u)
SELECT conv_id, turn, touched OR (i AND max(CASE WHEN touched THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, run ORDER BY turn) = 1) AS affected FROM r
""")
def affected_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that an edit touches, and the 'Id.' units that hang on them."""
    t = F.col("turn")
    c = table(spark, sf_dir, "conversations")
    u = c.select("conv_id", "turn", (t * 10).alias("start"), (t * 10 + 9).alias("end"), (t % 4 == 0).alias("has_full"), (t % 4 == 2).alias("is_id"))
    r = c.where(t % 5 == 1).select("conv_id", (t * 10 + 2).alias("r_start"), (t * 10 + 4).alias("r_end"))
    return B.affected_units(u, r, "conv_id").select("conv_id", "turn", "affected")


@query("SELECT o_custkey AS doc, count(*) FILTER (WHERE o_orderkey % 97 = 0) = 0 OR count(*) FILTER (WHERE o_orderkey % 97 <> 0) = 0 AS in_sequence FROM orders GROUP BY 1")
def page_sequence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed page numbers that run with the pages, roman and arabic apart."""
    k = F.col("o_orderkey")
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), k.alias("page"), F.lit(False).alias("roman"), (k + 3 + F.when(k % 97 == 0, 1).otherwise(0)).alias("value"))
    return B.page_sequence(p, "doc")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
m AS (SELECT doc_id, unnest(regexp_extract_all(line, '[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,24}')) AS detail FROM l WHERE line NOT LIKE '%leak-scan: allow%')
SELECT doc_id, 'email' AS kind, detail, count(*) AS n FROM m WHERE lower(split_part(detail, '@', 2)) NOT IN ('example.com', 'example.org', 'example.net', 'example.edu')
  AND lower(regexp_extract(detail, '\\.([A-Za-z]+)$', 1)) NOT IN ('example', 'invalid', 'test', 'localhost', 'txt', 'py', 'md', 'json', 'pdf', 'html', 'csv')
  AND lower(split_part(detail, '@', 1)) NOT IN ('noreply', 'no-reply', 'donotreply', 'do-not-reply') GROUP BY 1, 2, 3
""")
def leak_scan_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that leaks from documents: the given texts hold addresses, no home paths and no transcript marks."""
    from ..operators import leaks

    found = leaks.scan(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return found.groupBy("doc_id", "kind", "detail").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'home-path' WHEN 1 THEN 'email' WHEN 3 THEN 'session-transcript' WHEN 5 THEN 'case-pattern' END AS kind,
  CASE o_orderkey % 6 WHEN 0 THEN '/home/kim' || o_custkey || '/x.txt' WHEN 1 THEN 'kim' || o_custkey || '@law.org' WHEN 3 THEN 'SessionStart:boot hook' WHEN 5 THEN 'pattern #1' END AS detail, 2 AS line_no
FROM orders WHERE o_orderkey % 6 NOT IN (2, 4)
""")
def leak_scan_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class of finding on composed lines; placeholders and allowed lines stay silent."""
    from ..operators import leaks

    k, c = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    line = (
        F.when(k == 0, F.concat(F.lit("see /home/kim"), c, F.lit("/x.txt, then"))).when(k == 1, F.concat(F.lit("write kim"), c, F.lit("@law.org or noreply@law.org")))
        .when(k == 2, "path /home/user/x and a@example.com").when(k == 3, "SessionStart:boot hook").when(k == 4, F.concat(F.lit("kim@law.org leak-scan: allow"))).otherwise("the SEALED matter")
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("first\n"), line).alias("text"))
    return leaks.scan(o, "text", ["o_orderkey"], ["sealed matter"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'a/<masked>/b.txt' ELSE 'a/c' || o_custkey || '/b.txt' END AS masked FROM orders")
def leak_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with the leaking part masked."""
    from ..operators import leaks

    p = F.concat(F.lit("a/"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("kim@law.org")).otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))), F.lit("/b.txt"))
    return table(spark, sf_dir, "orders").select("o_orderkey", leaks.mask_path(p).alias("masked"))
