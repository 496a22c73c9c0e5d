"""Queries over notices, drafts, contacts and requests, composed from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correspondence as C
from ..session import table
from .registry import query


def _key() -> Column:
    return F.col("o_orderkey")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'P')")
def amendments_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amendments under an alias of two statuses."""
    return C.status_filter(_orders(spark, sf_dir), "o_orderstatus", "open", {"open": ["O", "P"], "all": None}).select("o_orderkey")


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'kim' || o_custkey WHEN 1 THEN 'agent:a' || o_custkey || ', directed by kim' END AS attribution FROM orders
""")
def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who wrote it and at whose direction; agents alone, blanks and the form's own marks are refused."""
    m, who = _key() % 5, F.col("o_custkey")
    author = F.when(m == 0, _text("kim", who)).when(m.isin(1, 2), _text("agent:a", who)).when(m == 3, " ").otherwise(_text("a, b", who))
    return _orders(spark, sf_dir).select("o_orderkey", C.attribution(author, F.when(m == 1, "kim")).alias("attribution"))


@query("""
SELECT o_orderkey, sha256('{"customer":' || o_custkey || ',"note":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"n' || o_orderkey || '"' END || ',"status":"' || o_orderstatus || '"}') AS sha256 FROM orders
""")
def record_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical JSON of a record, hashed."""
    o = _orders(spark, sf_dir).select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(_key() % 3 != 0, _text("n", _key())).alias("note"), F.col("o_custkey").alias("customer"))
    return C.record_hash(o, ["status", "note", "customer"]).select("o_orderkey", "sha256")


@query("SELECT o_custkey AS customer, 1 AS keys FROM orders GROUP BY 1")
def search_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that differ in blanks and case share a cache key."""
    q = F.when(_key() % 2 == 0, _text("  Due   PROCESS ", F.col("o_custkey"))).otherwise(_text("due process ", F.col("o_custkey"), " "))
    o = _orders(spark, sf_dir).select(F.col("o_custkey").alias("customer"), C.search_key(F.lit("Court"), F.lit(None).cast("string"), q).alias("k"))
    return o.groupBy("customer").agg(F.count_distinct("k").cast("int").alias("keys"))


@query("""
WITH p AS (SELECT p_partkey, 'DESCRIPTION:' || p_name || '\\, ' || p_type || '\\; ' || p_name || ' and ' || p_name || '\\n' || p_brand || ' ' || p_type || ' ' || p_name AS s FROM part)
SELECT p_partkey, CASE WHEN length(s) <= 75 THEN s ELSE left(s, 75) || regexp_replace(substr(s, 76), '(.{1,74})', chr(13) || chr(10) || ' \\1', 'g') END AS line FROM p
""")
def calendar_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar text escaped and folded by octets."""
    s = _text(F.col("p_name"), ", ", F.col("p_type"), "; ", F.col("p_name"), " and ", F.col("p_name"), "\n", F.col("p_brand"), " ", F.col("p_type"), " ", F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", C.calendar_fold(F.concat(F.lit("DESCRIPTION:"), C.calendar_escape(s))).alias("line"))


@query("""
WITH p AS (SELECT p_partkey, repeat('é', CAST(p_partkey % 150 + 20 AS INTEGER)) AS t FROM part)
SELECT p_partkey, 'DESCRIPTION:' || CASE WHEN length(t) <= 31 THEN t ELSE left(t, 31) || regexp_replace(substr(t, 32), '(.{1,37})', chr(13) || chr(10) || ' \\1', 'g') END AS line FROM p
""")
def calendar_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar text of characters that take two octets each: 75 octets a line, not characters."""
    t = F.repeat(F.lit("é"), (F.col("p_partkey") % 150 + 20).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", C.calendar_fold(F.concat(F.lit("DESCRIPTION:"), C.calendar_escape(t))).alias("line"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || ' of ' || c_mktsegment WHEN c_custkey % 3 = 1 THEN c_name || ', ' || c_mktsegment ELSE c_name END AS line FROM customer")
def to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addressees with their organisation, unless the name holds it."""
    m = F.col("c_custkey") % 3
    name = F.when(m == 0, _text(F.col("c_name"), " of ", F.col("c_mktsegment"))).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.to_line(name, F.when(m == 2, "").otherwise(F.col("c_mktsegment"))).alias("line"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN 'address is not quoted from the source' END AS refused FROM customer")
def email_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that were guessed."""
    m = F.col("c_custkey") % 3
    mail = F.when(m == 2, "").otherwise(_text("Kim", F.col("c_custkey"), "@law.org"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.guessed_email(mail, F.when(m == 0, _text("write to kim", F.col("c_custkey"), "@LAW.org now"))).alias("refused"))


#: Bodies of letters and why each is refused.
_LETTERS = [
    ("We write to ask.", None), ("You can START your Business here", "start your business"), ("or form your LLC today", "form your llc"), ("See attached.", "see attached"), ("Attached please find it", "attached please find"),
    ("It is in Exhibit A, exhibit 4", "exhibit a"), ("an affidavit excerpt", "affidavit excerpt"), ("I have strong evidence that he did", "i have strong evidence that"), ("The defendant did the following:", "the defendant did the following"),
    ("See Exhibit  12 there", "exhibit"), ("an exhibit of art; exhibit b", None), ("no exhibits 4", None), ("Write to ACME.example", "acme.example"),
]
_REFUSED = ", ".join(f"({i}, {f"'{v}'" if v else 'NULL'})" for i, (_, v) in enumerate(_LETTERS))


@query(f"SELECT o_orderkey, v AS reason FROM orders JOIN (VALUES {_REFUSED}) t(m, v) ON o_orderkey % {len(_LETTERS)} = m")
def unsafe_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters with phrases or exhibits that they must not hold."""
    body = F.element_at(F.array(*[F.lit(x) for x, _ in _LETTERS]), (_key() % len(_LETTERS) + 1).cast("int"))
    return _orders(spark, sf_dir).select("o_orderkey", C.unsafe_reason(F.lit("Notice"), body, own=["acme.example"]).alias("reason"))


@query("SELECT event_id, event_id % 5 = 0 OR date_diff('day', CAST(ts AS DATE), DATE '2024-04-10') > 90 AS stale FROM events")
def stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources read over ninety days ago; unreadable times are stale."""
    when = F.when(F.col("event_id") % 5 == 0, "last week").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", C.stale(when, F.to_date(F.lit("2024-04-10"))).alias("stale"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, o_orderdate, o_orderkey) AS place FROM orders")
def amendment_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By status, then age, then key."""
    o = C.numbered(_orders(spark, sf_dir), [*C.by_status(["P", "F"], F.col("o_orderstatus")), F.col("o_orderdate"), F.col("o_orderkey")], ["o_custkey"])
    return o.select("o_orderkey", "place")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) AS place FROM lineitem
""")
def problems_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes with problems before the others."""
    order = [*C.by_status(["R", "A"], F.col("l_returnflag")), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")]]
    return C.numbered(table(spark, sf_dir, "lineitem"), order, ["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "place")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY lower(p_name), p_partkey) AS place FROM part")
def path_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in order, case aside."""
    p = table(spark, sf_dir, "part").withColumn("path", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")))
    return C.numbered(p, [F.lower("path"), F.col("p_partkey")], ["p_size"]).select("p_partkey", "place")


@query("""
WITH s AS (SELECT l_orderkey AS n, string_agg(CASE WHEN l_partkey % 10 = 3 THEN '?' ELSE p_name END, ';' ORDER BY l_linenumber, l_partkey) AS texts, count(*) FILTER (WHERE l_partkey % 10 = 3 OR p_partkey IS NULL) AS missing
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT o_orderkey AS notice_id, CASE WHEN o_custkey % 7 <> 0 THEN c_name END AS party_name, coalesce(texts, '') AS texts, coalesce(missing, 0) AS missing FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN s ON n = o_orderkey
""")
def notice_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices with their party and selected assertions; parties and assertions can be missing."""
    n = _orders(spark, sf_dir).select(_key().alias("notice_id"), F.col("o_custkey").alias("party_id"))
    parties = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("party_id"), F.col("c_name").alias("party_name"))
    chosen = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("notice_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("assertion_id")).distinct()
    known = table(spark, sf_dir, "part").where("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("assertion_id"), F.col("p_name").alias("text"))
    return C.notice_ledger(n, parties, chosen, known).select("notice_id", "party_name", F.array_join("texts", ";").alias("texts"), "missing")


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) - 1) // 40 AS batch FROM orders")
def request_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests bounded by characters before they are by cites."""
    o = _orders(spark, sf_dir).select((F.col("o_custkey") % 20).alias("draft"), "o_orderkey", F.lpad(_key().cast("string"), 15, "0").alias("line"))
    return C.request_batches(o, "draft", "o_orderkey", "line", 60, 16 * 40).select("o_orderkey", "batch")


@query("SELECT o_orderkey, o_orderkey % 5 = 0 AS valid FROM orders")
def request_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests within the grammar of lines, without repeats, within bounds."""
    # Pages of at most four digits, with one more in the second line: the grammar's pages end at six, keys don't.
    a, m = _text(_key() % 900 + 1, " F.3d ", F.col("o_custkey") % 9_999 + 1), _key() % 5
    payload = F.when(m == 0, F.concat(a, F.lit("\n"), a, F.lit("1"))).when(m == 1, F.concat(a, F.lit("\n"), a)).when(m == 2, F.concat(a, F.lit("; drop"))).when(m == 3, F.lit("")).otherwise(F.repeat(F.lit("x"), 99))
    return _orders(spark, sf_dir).select("o_orderkey", C.valid_request(payload).alias("valid"))


@query("SELECT o_custkey, v AS gap, n FROM (SELECT o_custkey, o_orderkey % 4 AS v, count(*) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderkey % 4) AS r FROM orders GROUP BY 1, 2) WHERE r = 1")
def common_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest value, ties to the least."""
    return C.modes(_orders(spark, sf_dir).select("o_custkey", (_key() % 4).alias("gap")), ["o_custkey"], "gap")


@query("SELECT user_id AS case_id, count(DISTINCT CASE WHEN event_id % 2 = 0 THEN event_type END) AS searches, count(DISTINCT CASE WHEN event_id % 2 = 1 THEN event_type END) AS cites FROM events GROUP BY 1")
def saved_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct searches and cites with a saved answer."""
    return C.saved_counts(table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.when(F.col("event_id") % 2 == 0, "search").otherwise("cite").alias("kind"), F.col("event_type").alias("key")))


@query("""
WITH c AS (SELECT c_custkey AS case_id FROM customer), o AS (SELECT o_custkey AS case_id, count(*) AS documents, count(*) FILTER (WHERE o_orderstatus = 'O') AS "open",
  count(*) FILTER (WHERE o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) < DATE '1998-06-01') AS overdue, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS waiting, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS unverified,
  count(*) FILTER (WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS unsupported FROM orders GROUP BY 1)
SELECT case_id, coalesce(documents, 0) AS documents, coalesce(documents, 0) AS facts, coalesce(unsupported, 0) AS unsupported, coalesce("open", 0) AS "open", coalesce(overdue, 0) AS overdue, coalesce(waiting, 0) AS waiting, coalesce(unverified, 0) AS unverified FROM c LEFT JOIN o USING (case_id)
""")
def case_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of every case."""
    o = _orders(spark, sf_dir).withColumnRenamed("o_custkey", "case_id")
    due = o.select("case_id", F.when(F.col("o_orderstatus") == "O", "open").otherwise("met").alias("state"), F.to_date("o_orderdate").alias("due"))
    auth = o.select("case_id", F.when(F.col("o_orderpriority").startswith("1"), "unverified").otherwise("resolved").alias("status"))
    sources = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fact_id"))
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"))
    return C.case_overview(cases, o, o.select("case_id", _key().alias("fact_id")), sources, due, auth, o.where(_key() % 3 == 0), F.to_date(F.lit("1998-06-01")))
