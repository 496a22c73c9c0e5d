"""Queries over the workspace, composed from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import leaks, ledgers, scoring
from ..operators import workspace as W
from ..session import table
from ..sources import texts
from .registry import query


def _key() -> Column:
    return F.col("o_orderkey")


def _cust() -> Column:
    return F.col("o_custkey")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("""
WITH r AS (SELECT DISTINCT o_custkey AS c FROM orders), p AS (SELECT 'case' || c AS rel, 1 AS depth, NULL AS up FROM r UNION ALL SELECT 'case' || c || '/sub', 2, 'case' || c FROM r WHERE c % 2 = 0 UNION ALL SELECT 'case' || c || '/x/sub', 3, 'case' || c FROM r WHERE c % 3 = 0)
SELECT left(sha256(rel), 16) AS case_id, rel, depth, left(sha256(up), 16) AS parent_id FROM p
""")
def case_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases and subcases of a workspace to depth three, with their nearest case above."""
    rel = F.array(_text("case", _cust()), F.when(_cust() % 2 == 0, _text("case", _cust(), "/sub/")), F.when(_cust() % 3 == 0, _text("case", _cust(), "/x/sub")), _text("case", _cust(), "/a/b/c"))
    return W.discover(_orders(spark, sf_dir).select(F.explode(rel).alias("rel")).where("rel is not null"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'changed' WHEN doc_id % 4 = 0 THEN 'text copy' WHEN doc_id % 3 = 0 THEN 'stored pages' WHEN doc_id % 2 = 1 THEN 'text file' WHEN doc_id % 5 = 0 THEN 'pdf text' ELSE 'none' END AS label,
  CASE WHEN doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND (doc_id % 4 = 0 OR doc_id % 3 = 0 OR doc_id % 2 = 1 OR doc_id % 5 = 0) THEN text END AS text FROM documents
""")
def text_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a document's text is read from; changed bytes are not read."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id")
    docs = d.select("doc_id", F.lit("a").alias("stored_sha"), F.when(k % 11 == 0, None).when(k % 7 == 0, "b").otherwise("a").alias("found_sha"))
    return W.text_source(docs, d.where(k % 4 == 0), d.where(k % 3 == 0), d.where(k % 2 == 1), d.where(k % 5 == 0))


@query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'source' WHEN 1 THEN 'above a source' WHEN 2 THEN 'store' END AS protected FROM orders")
def protected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that must not be written: sources, folders above them, members of stores."""
    m = _key() % 5
    p = F.when(m == 0, _text("./Case", _cust(), "//Docs/A.pdf")).when(m == 1, _text("CASE", _cust(), "/docs/")).when(m == 2, _text("case", _cust(), "/store/x/y")).when(m == 3, _text("case", _cust(), "/docs/b.pdf")).otherwise(_text("other", _cust()))
    c = table(spark, sf_dir, "customer")
    src = c.select(_text("case", F.col("c_custkey"), "/docs/a.pdf").alias("path"))
    got = W.classify_paths(_orders(spark, sf_dir).select(p.alias("path")).distinct(), src, c.select(_text("case", F.col("c_custkey"), "/store").alias("path")))
    return _orders(spark, sf_dir).select("o_orderkey", p.alias("path")).join(got, "path").select("o_orderkey", "protected")


@query("""
SELECT o_orderkey AS case_id, e AS entry, CASE e WHEN '16' THEN 'a' || o_orderkey || '.pdf' ELSE 'b.pdf' END AS rel_path FROM orders, (VALUES ('16'), ('17')) t(e) WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 3 = 0
""")
def docket_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Docket maps out of JSON sidecars; other shapes give a row to refuse."""
    j = F.when(_key() % 3 == 0, '{"list": [1]}').otherwise(_text('{"entries": {"16": "a', _key(), '.pdf", "17": "b.pdf"}}'))
    return W.docket_map(_orders(spark, sf_dir).select(_key().alias("case_id"), j.alias("json")))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 97 IN (0, 1))")
def brief_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Research briefs: all rows of one, or none."""
    t = F.when(_key() % 97 == 0, None).when(_key() % 97 == 1, "  ").otherwise("title")
    return W.import_briefs(_orders(spark, sf_dir).select(_cust().alias("brief_id"), "o_orderkey", t.alias("title")), ["title", "o_orderkey"]).select("o_orderkey")


@query("""
WITH h AS (SELECT o_orderkey AS k, md5(CAST(o_orderkey AS VARCHAR)) AS a, md5('x' || o_orderkey) AS b FROM orders), u AS (SELECT k, substr(a, 1, 8) || '-' || substr(a, 9, 4) || '-' || substr(a, 13, 4) || '-' || substr(a, 17, 4) || '-' || substr(a, 21, 12) AS a, substr(b, 1, 8) || '-' || substr(b, 9, 4) || '-' || substr(b, 13, 4) || '-' || substr(b, 17, 4) || '-' || substr(b, 21, 12) AS b FROM h)
SELECT k AS o_orderkey, a AS uuid, 0 AS n, 'First ' || k AS title FROM u UNION ALL SELECT k, b, 1, 'Second' FROM u
""")
def result_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of result texts in two written forms, the first of each id."""
    h = lambda c: F.concat_ws("-", *[F.substring(F.md5(c.cast("string").cast("binary")), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    a, b = h(_key()), h(_text("x", _key()))
    t = _text("Found: [First ", _key(), "](id:", a, ") and\n", b, ": Second\n", a, ": again\nnot an id: x")
    return W.result_hits(_orders(spark, sf_dir).select("o_orderkey", t.alias("text")), "text", ["o_orderkey"])


@query("WITH p AS (SELECT sha256(html) AS s, url, page_id FROM pages) SELECT s AS sha256, arg_min(url, (page_id, url)) AS url FROM p WHERE s NOT IN (SELECT s FROM p WHERE page_id % 5 = 0) GROUP BY 1")
def web_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New documents among captured pages."""
    p = table(spark, sf_dir, "pages")
    stored = p.where("page_id % 5 = 0").select(F.sha2("html", 256).alias("sha256"))
    return W.captures(p.select("url", F.col("page_id").alias("at"), F.col("html").alias("body")), stored)[0]


@query("SELECT sha256(html) AS sha256, count(*) AS n_captures, arg_max(url, (page_id, url)) AS last_url FROM pages GROUP BY 1 UNION ALL SELECT 'none', 0, NULL")
def document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their captures."""
    p = table(spark, sf_dir, "pages")
    seen = W.captures(p.select("url", F.col("page_id").alias("at"), F.col("html").alias("body")), p.select(F.lit("x").alias("sha256")).limit(0))[1]
    docs = seen.select("sha256").distinct().union(spark.range(1).select(F.lit("none")))
    return W.document_list(docs, seen).select("sha256", "n_captures", "last_url")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'k' || o_orderkey || chr(65533) ELSE 'é' || o_orderkey END AS text FROM orders")
def replaced_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes read as UTF-8, bad ones replaced, the mark dropped."""
    c = F.when(_key() % 3 == 0, F.concat(_text("k", _key()).cast("binary"), F.unhex(F.lit("FF")))).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), _text("é", _key()).cast("binary")))
    return W.read_text(_orders(spark, sf_dir).select("o_orderkey", c.alias("content"))).select("o_orderkey", "text")


@query("""
SELECT o_custkey AS case_id, '# Orders' || chr(10) || chr(10) || '| o_orderkey | note |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || o_orderkey || ' | a\\|b ' || o_orderstatus || ' |', chr(10) ORDER BY o_orderkey) || chr(10) AS markdown,
  '[' || string_agg('{"o_orderkey":' || o_orderkey || ',"note":"a|b\\n' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']' AS manifest FROM orders GROUP BY 1
""")
def case_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown report and a JSON manifest for each case."""
    o = _orders(spark, sf_dir).select(_cust().alias("case_id"), "o_orderkey", _text("a|b\n", F.col("o_orderstatus")).alias("note"))
    return W.report(o, "case_id", "Orders", ["o_orderkey"], ["o_orderkey", "note"])


@query("""
WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey AS seq, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS r FROM orders) SELECT day, seq, r = 1 AND day NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_custkey % 10 = 0) AS added FROM a
""")
def holiday_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holidays registered once a day."""
    o = _orders(spark, sf_dir).select(F.to_date("o_orderdate").alias("day"), F.lit("x").alias("name"), _key().alias("seq"), _cust().alias("c"))
    return W.register_holidays(o.where("c % 10 = 0"), o.select("day", "name", "seq")).select("day", "seq", "added")


@query("""
WITH l AS (SELECT user_id AS c, event_type AS p, event_id AS s, ['propose', 'activate', 'decline', 'revoke'][event_id % 4 + 1] AS a, event_id % 3 <> 0 AS person FROM events), k AS (SELECT * FROM l WHERE person OR a = 'propose'),
g AS (SELECT c, p, arg_max(a, s) AS a, arg_max(a, s) FILTER (WHERE a <> 'propose') AS d FROM k GROUP BY 1, 2)
SELECT c AS case_id, p AS provider, CASE a WHEN 'propose' THEN CASE WHEN d = 'activate' THEN 'active' ELSE 'proposed' END WHEN 'activate' THEN 'active' WHEN 'decline' THEN 'declined' ELSE 'revoked' END AS state FROM g
""")
def grant_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each case's grants after their log."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    action = F.when(i % 4 == 0, "propose").when(i % 4 == 1, "activate").when(i % 4 == 2, "decline").otherwise("revoke")
    return W.active_grants(e.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("provider"), action.alias("action"), i.alias("seq"), (i % 3 != 0).alias("by_person")))


@query("""
WITH o AS (SELECT o_custkey AS c, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1)
SELECT c_custkey AS case_id, number, step, CASE number WHEN 1 THEN coalesce(n, 0) > 0 ELSE coalesce(p, 0) > 0 END AS done FROM customer LEFT JOIN o ON c = c_custkey, (VALUES (1, 'documents'), (2, 'parties')) t(number, step)
""")
def intake_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which steps of its intake each case has done."""
    n = _orders(spark, sf_dir).groupBy(_cust().alias("case_id")).agg(F.count("*").alias("documents"), F.count_if(F.col("o_orderstatus") == "P").alias("parties"))
    return W.intake_steps(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id")), n)


@query("""
WITH d AS (SELECT o_custkey AS c, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS due FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT c_nationkey AS parent_id, c_custkey AS case_id, c_name || ': ' || CASE WHEN n IS NULL THEN 'no open deadlines' WHEN n = 1 THEN '1 open deadline, due ' || due ELSE n || ' open deadlines, next ' || due END AS line FROM customer LEFT JOIN d ON c = c_custkey
""")
def subcase_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status lines of subcases."""
    d = _orders(spark, sf_dir).select(_cust().alias("case_id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("met").alias("state"), F.to_date("o_orderdate").alias("due"))
    return W.child_lines(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("parent_id"), F.col("c_custkey").alias("case_id"), F.col("c_name").alias("title")), d)


@query("SELECT o_custkey AS k, arg_max(o_orderkey, o_orderkey) AS v, max(o_orderkey) AS line_no FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1")
def append_log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest whole record of each key in a log with torn lines."""
    line = F.when(_key() % 7 == 0, _text('{"k": ', _cust(), ', "v"')).otherwise(_text('{"k": ', _cust(), ', "v": ', _key(), "}"))
    return texts.append_log(_orders(spark, sf_dir).select(line.alias("value"), _key().alias("line_no")), "k long, v long", ["k"])


@query("""
SELECT o_orderkey, 'Cite ' || o_custkey || ' | x' AS citation, ['unverified', 'source-checked', 'resolved', 'unverified', NULL, 'source-checked'][o_orderkey % 6 + 1] AS status, CASE WHEN o_orderkey % 6 <> 3 THEN 'book ' || o_custkey END AS source, o_orderkey % 6 = 5 AS pins_unconfirmed, CASE WHEN o_orderkey % 2 = 0 THEN 'holds' END AS proposition FROM orders
""")
def markdown_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An authority ledger in Markdown; columns are told by their headings, in any order, some missing."""
    m = _key() % 6
    cell = F.element_at(F.array(*[F.lit(x) for x in ("V-LEAD, partly unverified", "v-lead", "V-WORKER", "V-LEAD pins confirmed", "seen", "V-LEAD (2020)")]), (m + 1).cast("int"))
    source = F.when(m == 3, "—").otherwise(_text("book ", _cust()))
    even = _text("# Ledger\n\n| Status | Full citation | Source | Used for |\n|---|:--|--|--|\n| ", cell, " | Cite ", _cust(), " \\| x | ", source, " | holds |\n| V-LEAD | - | s | |\n\n| not | a table |\n")
    odd = _text("| Primary source | Authority | Notes | Status now |\n|:--:|---|---|---|\n| ", source, " | Cite ", _cust(), " \\| x | | ", cell, " |\nend")
    rows = texts.markdown_tables(_orders(spark, sf_dir).select("o_orderkey", F.when(_key() % 2 == 0, even).otherwise(odd).alias("text")), "text", "o_orderkey")
    return ledgers.authority_rows(texts.by_heading(rows, ledgers.LEDGER_COLUMNS)).select("o_orderkey", "citation", "status", "source", "pins_unconfirmed", "proposition")


@query("SELECT o_orderkey, 'a - b ' || o_custkey || ' fi ''q'' \"x\"' AS plain, '42usc' || o_custkey || '.5' AS key FROM orders")
def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with plain spaces, dashes, quotes and ligatures; an authority's key."""
    odd = _text("\u00a0a\u2009\u2013\u00a0 b\u200b ", _cust(), "\n\t\ufb01 \u2018q\u2019 \u201cx\u201d \ufeff")
    return _orders(spark, sf_dir).select("o_orderkey", S.normalize(odd).alias("plain"), S.authority_key(_text("42 U.S.C. § ", _cust(), ".5.")).alias("key"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'PRIVILEGED' WHEN 1 THEN 'ALLEGED' END AS label, 'a\\|b c' || o_custkey AS cell, o_custkey || 'us' || o_orderkey AS word, '12' || o_custkey AS digits, '(a) Title: bold code link' AS plain FROM orders")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, table cells, word keys, digits of other scripts, plain text."""
    m = _key() % 3
    label = F.when(m == 0, " privileged ").when(m == 1, "Alleged").otherwise("rumour")
    md = F.lit("## (a) Title: **bold** `code` [link](http://x.y)")
    return _orders(spark, sf_dir).select(
        "o_orderkey", S.fact_label(label).alias("label"), S.table_cell(_text("a|b\r\nc", _cust())).alias("cell"), S.word_key(_text(_cust(), " U.S. ", _key())).alias("word"), S.ascii_digits(_text("١２", _cust())).alias("digits"), S.plain_terminal(md).alias("plain")
    )


@query("SELECT o_custkey AS doc, o_orderkey % 5 AS start, o_orderkey % 5 + 3 AS \"end\", count(*) - 1 AS repeats FROM orders GROUP BY 1, 2, 3")
def collapsed_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct predicted spans and their repeats."""
    return scoring.collapse(_orders(spark, sf_dir).select(_cust().alias("doc"), (_key() % 5).alias("start"), (_key() % 5 + 3).alias("end")))


@query("SELECT o_orderkey, 'k' || o_orderkey AS text FROM orders WHERE o_orderkey % 3 = 1")
def scannable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the leak scan reads: no zero byte at their head, not over the size."""
    c = F.when(_key() % 3 == 0, F.concat(_text("k", _key()).cast("binary"), F.unhex(F.lit("00")))).when(_key() % 3 == 1, _text("k", _key()).cast("binary")).otherwise(F.repeat(F.lit("x"), 99).cast("binary"))
    return leaks.scannable(_orders(spark, sf_dir).select("o_orderkey", c.alias("content")), 64).select("o_orderkey", "text")


@query("""
SELECT doc_id, n, CASE n WHEN 0 THEN 'See Smith v. Jones, Inc. at ' || doc_id || '.' WHEN 1 THEN 'Mr. A. Roe said “No. Go.” then!' ELSE 'Done (id. at 4.)' END AS sentence FROM documents, (VALUES (0), (1), (2)) t(n)
""")
def composed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences past abbreviations, initials and quotations."""
    from ..operators import quotes

    t = _text("See Smith v. Jones, Inc. at ", F.col("doc_id"), ". Mr. A. Roe said “No. Go.” then!  Done (id. at 4.)")
    return quotes.sentences(table(spark, sf_dir, "documents").select("doc_id", t.alias("text")), "text", ["doc_id"]).select("doc_id", "n", "sentence")


#: Sentences on end, as they must be cut: states that are words, hours, and states that a cite goes on after.
_CUTS = [
    ["He lived in Mass.", "The car @ was red."], ["It was at 5 p.m.", "Then he left for @."], ["It was tried in Ind.", "Trial began on day @."], ["Ind. Trial R. @ applies.", "It says so."], ["See 100 Wash. 2d @ there.", "So it is."],
    ["Under Ill. Const. art. I it is @.", "So."], ["Mass. Gen. Laws ch. @ says so.", "It does."], ["It was held (Mass. 1985) in @.", "So."], ["8 Del. C. § @ holds.", "Then more."], ["He was ill.", "The man @ left."], ["Me. Rev. Stat. tit. @ says.", "So."], ["He came to Me.", "Rev. Smith met him @."],
]


@query(f"SELECT doc_id, n, replace(t, '@', CAST(doc_id AS VARCHAR)) AS sentence FROM documents JOIN (VALUES {', '.join(f"({i}, {n}, '{t}')" for i, cut in enumerate(_CUTS) for n, t in enumerate(cut))}) v(m, n, t) ON doc_id % {len(_CUTS)} = m")
def state_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that end with a state's name, and those in which a cite goes on after it."""
    from ..operators import quotes

    t = F.element_at(F.array(*[F.lit(" ".join(cut)) for cut in _CUTS]), (F.col("doc_id") % len(_CUTS) + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.replace(t, F.lit("@"), F.col("doc_id").cast("string")).alias("text"))
    return quotes.sentences(d, "text", ["doc_id"]).select("doc_id", "n", "sentence")


@query("SELECT page_id, 'Head ' || page_id || chr(10) || 'a' || chr(10) || 'b' || chr(10) || '& c' AS visible FROM pages")
def composed_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of composed pages: scripts, styles and hidden parts left out."""
    h = _text("<html><head><title>Head ", F.col("page_id"), "</title><style>p {x: y}</style></head><body><script>var a = '<p>no</p>';</script><p>a <b>b</b> &amp; c</p><noscript>n</noscript></body></html>")
    return texts.with_visible_text(table(spark, sf_dir, "pages").select("page_id", h.alias("html")), "html").select("page_id", "visible")
