"""Queries over facts, drafts, authorities, dockets and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import cases
from ..operators import ledgers as L
from ..session import table
from .registry import query


@query("""
SELECT d.doc_id AS fact_id, count(l.doc_id) AS n_sources, coalesce(string_agg(d.source || '/' || d.doc_id || '@p. ' || l.quality, '; ' ORDER BY l.quality), '') AS refs
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id
""")
def facts_with_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with their sources' documents."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    facts = d.select(F.col("doc_id").alias("fact_id"))
    src = lab.select(F.col("doc_id").alias("fact_id"), "doc_id", F.concat(F.lit("p. "), F.col("quality").cast("string")).alias("locator"))
    docs = d.select("doc_id", F.concat_ws("/", "source", "doc_id").alias("rel_path"))
    out = L.facts_with_sources(facts, src, docs)
    return out.select("fact_id", F.size("sources").cast("long").alias("n_sources"), F.array_join(F.transform("sources", lambda s: F.concat_ws("@", s["rel_path"], s["locator"])), "; ").alias("refs"))


@query("SELECT doc_id AS fact_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unsupported_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts without a source."""
    return L.unsupported(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fact_id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("fact_id")))


@query("SELECT s AS status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) t(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status, zero where none stands."""
    return L.count_statuses(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")), "status", ["F", "O", "P", "X"])


@query("SELECT count(*) AS n FROM (SELECT nullif(event_type, (SELECT min(event_type) FROM events)) AS s FROM events) WHERE s NOT IN ('click', 'view')")
def unverified_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN over a column with nulls."""
    e = table(spark, sf_dir, "events")
    least = e.agg(F.min("event_type").alias("least"))
    return L.not_in_count(e.join(F.broadcast(least), F.col("event_type") == F.col("least"), "left").select(F.when(F.col("least").isNull(), F.col("event_type")).alias("status")), "status", ["click", "view"])


@query("""
SELECT o_custkey AS case_id, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open,
  count(*) FILTER (WHERE o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) < DATE '1998-06-01') AS n_overdue,
  min(CASE WHEN o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) >= DATE '1998-06-01' THEN CAST(o_orderdate AS DATE) END) AS next_due,
  substr(min(CASE WHEN o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) >= DATE '1998-06-01' THEN strftime(o_orderdate, '%Y-%m-%d') || 'order ' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') END), 11) AS next_label
FROM orders GROUP BY 1
""")
def panel_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadline roll-up of each case."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("case_id"), F.to_date("o_orderdate").alias("due"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("met").alias("state"), F.concat(F.lit("order "), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("label")
    )
    return L.case_panel(o, "case_id", F.to_date(F.lit("1998-06-01")))


@query("""
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN CAST(o_orderdate AS DATE) < DATE '1998-06-01' THEN 0 ELSE 1 END, CAST(o_orderdate AS DATE), o_orderkey) AS INTEGER) AS place FROM orders
""")
def passed_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each deadline in its case's list, passed ones first."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("due"), F.col("o_orderkey").alias("label"))
    return o.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*L.passed_first(F.to_date(F.lit("1998-06-01"))))).alias("place"))


@query("""
SELECT l_orderkey AS item, string_agg(l_linenumber || ':' || coalesce(p_brand, '?'), ' ' ORDER BY l_linenumber, l_partkey) AS links FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size < 25 GROUP BY 1
""")
def link_roundup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items' links, left-joined to what they name, in order."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where("p_size < 25").select("p_partkey", "p_brand")
    rows = li.join(p, li.l_partkey == p.p_partkey, "left").select(F.col("l_orderkey").alias("item"), "l_linenumber", "l_partkey", F.concat_ws(":", "l_linenumber", F.coalesce("p_brand", F.lit("?"))).alias("t"))
    return L.ordered_text(rows, ["item"], "t", ["l_linenumber", "l_partkey"], " ").withColumnRenamed("joined", "links")


@query("""
SELECT o_orderkey, o_custkey, c_mktsegment FROM orders o JOIN customer ON c_custkey = o_custkey WHERE CAST(o_orderdate AS DATE) = (SELECT max(CAST(o_orderdate AS DATE)) FROM orders x WHERE x.o_custkey = o.o_custkey)
""")
def latest_draft_per_recipient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's newest orders, ties kept."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("created"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return L.latest_drafts(o, c, "o_custkey", "created").select("o_orderkey", "o_custkey", "c_mktsegment")


@query("""
WITH a AS (SELECT c_custkey AS ask_id, unnest([c_custkey % 700, c_custkey % 900 + 300]) AS k FROM customer), s AS (SELECT p_partkey AS auth_id, unnest([p_partkey % 500, p_partkey * 3]) AS k FROM part WHERE p_partkey % 4 = 0),
h AS (SELECT ask_id, count(DISTINCT auth_id) AS n, min(auth_id) AS auth_id FROM a JOIN s USING (k) GROUP BY 1)
SELECT c_custkey AS ask_id, coalesce(n, 0) AS n_found, CASE WHEN n = 1 THEN auth_id END AS auth_id, coalesce(n, 0) > 1 AS ambiguous FROM customer LEFT JOIN h ON h.ask_id = c_custkey
""")
def authority_key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations resolved by overlapping key sets; several hits are refused."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ask_id"), F.array(F.col("c_custkey") % 700, F.col("c_custkey") % 900 + 300).alias("keys"))
    s = table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("auth_id"), F.array(F.col("p_partkey") % 500, F.col("p_partkey") * 3).alias("keys"))
    return L.resolve_by_keys(a, s)


@query("""
WITH r AS (SELECT l_partkey AS k, l_orderkey, l_linenumber, ['source-checked', 'resolved', 'unverified', 'stale-flagged', 'other'][CAST(l_suppkey % 5 + 1 AS INTEGER)] AS status, l_suppkey % 5 AS rk FROM lineitem),
w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rk, l_orderkey, l_linenumber) AS n, count(*) OVER (PARTITION BY k) > 1 AS duplicated FROM r)
SELECT k, status, l_orderkey * 10 + l_linenumber AS entered, duplicated FROM w WHERE n = 1
""")
def best_authority_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best stage among duplicates of an authority."""
    names = F.array(*[F.lit(x) for x in (*L.AUTHORITY_RANK, "other")])
    r = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("entered"), F.element_at(names, (F.col("l_suppkey") % 5 + 1).cast("int")).alias("status"))
    return L.best_status(r, "k", "status", "entered")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'record-not-in-store' WHEN o_orderkey % 7 = 1 THEN 'source-missing' WHEN o_orderkey % 7 = 2 THEN 'source-changed' WHEN o_orderkey % 4 = 2 THEN 'record-unconfirmed' ELSE 'ok' END AS verdict FROM orders
""")
def docket_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Docket cites resolved to files and judged."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("case_id"), F.col("o_orderkey").cast("string").alias("entry_key"), F.concat(F.lit("f/"), F.col("o_orderkey").cast("string")).alias("rel_path"))
    k = F.col("o_orderkey")
    docket, names = o.where(k % 4 < 2).select("case_id", "entry_key", "rel_path"), o.where(k % 4 == 2).select("case_id", "entry_key", "rel_path")
    sha = F.sha2("rel_path", 256)
    files = o.select("case_id", "rel_path", sha.alias("stored_sha"), F.when(k % 7 == 1, None).when(k % 7 == 2, F.concat(F.lit("x"), sha)).otherwise(sha).alias("found_sha"))
    return L.docket_resolve(o.select("o_orderkey", "case_id", "entry_key"), docket, names, files).select("o_orderkey", "verdict")


@query("""
WITH s AS (SELECT DISTINCT o_custkey % 50 AS docket, o_orderkey // 50 + 1 AS n FROM orders WHERE o_orderkey % 3 <> 0),
w AS (SELECT docket, n, coalesce(lag(n) OVER (PARTITION BY docket ORDER BY n), 0) AS b FROM s)
SELECT docket, b + 1 AS lo, n - 1 AS hi FROM w WHERE n > b + 1
""")
def docket_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing docket numbers as ranges."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select((F.col("o_custkey") % 50).alias("docket"), F.expr("o_orderkey div 50 + 1").alias("n"))
    return L.gaps(o, "docket", "n")


@query("""
WITH f AS (SELECT user_id, event_type AS cite, min(event_id) AS first_at, count(*) AS times FROM events GROUP BY 1, 2)
SELECT user_id, cite, first_at, times, CAST(row_number() OVER (PARTITION BY user_id ORDER BY first_at) AS INTEGER) AS n FROM f
""")
def first_seen_cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct cites in order of first appearance."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("cite"), "event_id")
    return L.first_seen(e, ["user_id"], "cite", "event_id", [])


@query("SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS n_rows FROM documents GROUP BY 1")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each hash."""
    return L.first_wins(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), "doc_id"), "sha256", ["doc_id"])


@query("""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)
SELECT page_id, CASE WHEN host IN (SELECT host FROM p WHERE page_id % 10 = 0) THEN 'opted_out' END AS suppressed_for FROM p
""")
def sticky_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals of a host hold for all its pages."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"))
    return L.suppressed(p, p.where("page_id % 10 = 0").select("host", F.lit("opted_out").alias("reason")), "host").select("page_id", "suppressed_for")


@query("""
WITH p AS (SELECT page_id, lower(trim(regexp_extract(url, '^https?://([^/?#]+)', 1))) AS org, url FROM pages)
SELECT p.page_id AS page_id, (count(DISTINCT x.url) > 1) AS conflict FROM p JOIN p x ON p.org = x.org GROUP BY p.page_id
""")
def org_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations with more than one intake address."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("org"), "url")
    return L.conflicts(p, F.col("org"), "url").select("page_id", "conflict")


@query("SELECT event_type AS provider, CAST(ts AS DATE) AS day, count(*) AS used FROM events WHERE event_id % 9 <> 0 GROUP BY 1, 2")
def daily_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by provider and day, notes left out."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), "ts", F.when(F.col("event_id") % 9 == 0, "note").otherwise("sent").alias("event"))
    return L.budget_use(e, "provider", "ts", "event")


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), '; ' ORDER BY o_orderdate, o_orderkey) AS joined FROM orders GROUP BY 1")
def ordered_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as one line of text."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderkey").cast("string").alias("t"))
    return L.ordered_text(o, ["o_custkey"], "t", ["o_orderdate", "o_orderkey"])


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def newest_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest record of each key."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return L.newest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "ts")


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) - 1) // 60 AS batch FROM orders")
def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cites dealt to requests of sixty."""
    return L.batches(table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 20).alias("g")), "g", "o_orderkey").select("o_orderkey", "batch")


@query("""
SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 7, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 3 ELSE 0 END) AS INTEGER) AS place FROM orders
""")
def docket_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Docket keys in order of their numbers."""
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    key = F.concat((k % 7).cast("string"), F.when(k % 2 == 0, F.concat(F.lit("-"), (k % 3).cast("string"))).otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(Window.partitionBy("o_custkey").orderBy(*L.docket_order(key))).alias("place"))


@query("SELECT o_orderkey, CASE o_orderpriority[1:1] WHEN '2' THEN 0 WHEN '1' THEN 1 WHEN '3' THEN 2 ELSE 3 END AS rank FROM orders")
def rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status order that isn't the alphabet's."""
    first = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(first == "2", 0).when(first == "1", 1).when(first == "3", 2).otherwise(3).alias("rank"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty dearest orders: a top-k report."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'doc' || o_custkey ELSE 'd@' || o_custkey END AS ref_first, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'p. 4' ELSE 'x@p. 4' END AS loc_first,
  CASE WHEN o_orderkey % 3 = 2 THEN 'd@' || o_custkey || '@x' WHEN o_orderkey % 3 = 0 THEN 'doc' || o_custkey ELSE 'd@' || o_custkey END AS ref_last, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'p. 4' END AS loc_last
FROM (SELECT o_orderkey, o_custkey FROM orders)
""".replace("'d@' || o_custkey", "'d' || o_custkey"))
def source_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source references split at the first @ and at the last."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    ref = F.when(k % 3 == 0, F.concat(F.lit("doc"), c)).when(k % 3 == 1, F.concat(F.lit("d"), c, F.lit("@p. 4"))).otherwise(F.concat(F.lit("d"), c, F.lit("@x@p. 4")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", S.ref_parts(ref).alias("f"), S.ref_parts(ref, True).alias("l"))
    return o.select("o_orderkey", F.col("f.ref").alias("ref_first"), F.col("f.locator").alias("loc_first"), F.col("l.ref").alias("ref_last"), F.col("l.locator").alias("loc_last"))


@query("""
SELECT o_orderkey, 100 + o_orderkey % 50 AS lo, CASE WHEN o_orderkey % 2 = 0 THEN 100 + o_orderkey % 50 + 7 - (100 + o_orderkey % 50) % 10 + 0 ELSE 100 + o_orderkey % 50 END AS hi,
  (CASE WHEN o_orderkey % 2 = 0 THEN 100 + o_orderkey % 50 + 7 - (100 + o_orderkey % 50) % 10 ELSE 100 + o_orderkey % 50 END) <= 130 AND 100 + o_orderkey % 50 >= 100 AS covered FROM orders
""")
def pin_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page cites as ranges, short ends filled in, and whether a check of pages 100 to 130 covers them."""
    k = F.col("o_orderkey")
    lo = k % 50 + 100
    pin = F.when(k % 2 == 0, F.concat(lo.cast("string"), F.lit("-7"))).otherwise(lo.cast("string"))
    checked = F.array(F.struct(F.lit(100).cast("long").alias("lo"), F.lit(130).cast("long").alias("hi")))
    o = table(spark, sf_dir, "orders").select("o_orderkey", S.page_ranges(pin).alias("r"))
    return o.select("o_orderkey", F.col("r")[0]["lo"].alias("lo"), F.col("r")[0]["hi"].alias("hi"), S.ranges_covered(F.col("r"), checked).alias("covered"))


@query("""
WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderpriority LIKE '1%')
SELECT 'both' AS part, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'first', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
UNION ALL SELECT 'second', count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT 'neither', count(*) FROM (SELECT c_custkey FROM customer EXCEPT (SELECT k FROM a UNION SELECT k FROM b))
""")
def match_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys found by one parser, the other, both and neither."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    k = F.col("o_custkey").alias("k")
    return cases.in_sets(c, o.where("o_orderstatus = 'O'").select(k), o.where(F.col("o_orderpriority").startswith("1")).select(k), "k")
