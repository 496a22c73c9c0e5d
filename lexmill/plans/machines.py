"""Queries over state machines, grants and lookup answers, with truth computed from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import consent, lookups
from ..operators import machines as M
from ..session import table
from .registry import query


def _script(spark: SparkSession, sf_dir: str, steps: list[str], **cols: str) -> DataFrame:
    """Each order runs the same commands in order."""
    arr = F.array(*[F.lit(s) for s in steps])
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("target_id"), F.posexplode(arr).alias("seq", "to_state"))
    return o.withColumn("seq", F.col("seq").cast("long")).withColumns({k: F.expr(v) for k, v in cols.items()})


def _truth(rows: list[tuple[int, str, str, str]]) -> str:
    values = ", ".join(f"({s}, '{a}', '{b}', {r})" for s, a, b, r in rows)
    return f"SELECT o_orderkey AS target_id, CAST(s AS BIGINT) AS seq, a AS from_state, b AS to_state, r IS NULL AS accepted, r AS reason FROM orders, (VALUES {values}) t(s, a, b, r)"


@query(_truth([(0, "draft", "mailed", "'draft can''t become mailed'"), (1, "draft", "signed", "NULL"), (2, "signed", "mailed", "NULL"), (3, "mailed", "answered", "NULL"), (4, "answered", "signed", "'answered can''t become signed'")]))
def state_machine_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices moved through their life, with refusals."""
    return M.run(_script(spark, sf_dir, ["mailed", "signed", "mailed", "answered", "signed"], evidence="'r'"), M.NOTICE)


@query("""
WITH e AS (SELECT user_id AS target_id, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'fired' ELSE 'withdrawn' END AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
  first_value(CASE WHEN event_id % 2 = 0 THEN 'fired' ELSE 'withdrawn' END) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events)
SELECT target_id, seq, CASE WHEN n = 1 THEN 'waiting' ELSE f END AS from_state, s AS to_state, n = 1 AS accepted, CASE WHEN n > 1 THEN f || ' can''t become ' || s END AS reason FROM e
""")
def state_machine_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers fired or withdrawn once; the first command wins."""
    e = table(spark, sf_dir, "events")
    return M.run(e.select(F.col("user_id").alias("target_id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, "fired").otherwise("withdrawn").alias("to_state")), M.TRIGGER)


@query(_truth([(0, "proposed", "proposed", "'already proposed'"), (1, "proposed", "approved", "NULL"), (2, "approved", "filed", "'unknown state: filed'"), (3, "approved", "dropped", "NULL"), (4, "dropped", "proposed", "NULL")]))
def state_machine_amendment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amendments from any status to any other."""
    return M.run(_script(spark, sf_dir, ["proposed", "approved", "filed", "dropped", "proposed"]), M.AMENDMENT)


@query("""
WITH l AS (SELECT o_orderkey AS target_id, s, b FROM orders, (VALUES (0, 'met'), (1, 'met'), (2, 'vacated')) t(s, b))
SELECT target_id, CASE WHEN target_id % 4 = 0 THEN 'open' ELSE 'vacated' END AS state, CASE WHEN target_id % 4 = 0 THEN 0 ELSE 2 END AS accepted, CASE WHEN target_id % 4 = 0 THEN 3 ELSE 1 END AS refused FROM l WHERE s = 0
""")
def state_machine_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines' last states: a change and a reason are needed."""
    c = _script(spark, sf_dir, ["met", "met", "vacated"], reason="CASE WHEN target_id % 4 = 0 THEN ' ' ELSE 'ordered' END")
    return M.snapshot(M.run(c, M.DEADLINE), M.DEADLINE)


@query(_truth([(0, "unverified", "resolved", "NULL"), (1, "resolved", "source-checked", "'evidence is missing'"), (2, "resolved", "unverified", "NULL")]))
def state_machine_authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorities' stages: checking needs evidence."""
    return M.run(_script(spark, sf_dir, ["resolved", "source-checked", "unverified"], source="'p. 4'", evidence="cast(null as string)"), M.AUTHORITY)


@query(_truth([(0, "candidate", "simulated", "'candidate can''t become simulated'"), (1, "candidate", "shortlisted", "NULL"), (2, "shortlisted", "opted_out", "NULL"), (3, "opted_out", "response", "'opted_out can''t become response'")]))
def state_machine_outreach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outreach stages; a refusal is for good."""
    return M.run(_script(spark, sf_dir, ["simulated", "shortlisted", "opted_out", "response"]), M.OUTREACH)


@query("""
SELECT o_orderkey AS request_id, k IN (0, 6) AS allowed, CASE k WHEN 0 THEN 1 WHEN 6 THEN 6 END AS grant_id,
  CASE k WHEN 1 THEN 'an agent''s grant is a proposal' WHEN 2 THEN 'the daily budget is used up' WHEN 3 THEN 'turned off by a person' WHEN 4 THEN 'the grant has expired' WHEN 5 THEN 'no matching grant' WHEN 7 THEN 'payload outside the grant' END AS why
FROM (SELECT o_orderkey, o_orderkey % 8 AS k FROM orders)
""")
def authorize_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests against grants of every kind."""
    k = (F.col("o_orderkey") % 8).cast("string")
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit("p"), k).alias("provider"), F.when(k == "5", "other").otherwise("look").alias("endpoint"), F.when(k == "7", "text").otherwise("citation").alias("payload"), F.when(k == "6", "anyone").otherwise("kim").alias("caller"))
    rows = [(1, "p0", "human", ["look"], ["citation"], ["kim"], "lee", 9, None), (2, "p1", "agent", ["look"], ["citation"], ["*"], "bot", 9, None), (3, "p2", "human", ["look"], ["citation"], [], "kim", 5, None), (4, "p3", "default", ["look"], ["citation"], [], None, 9, None),
            (5, "p4", "human", ["look"], ["citation"], ["*"], "lee", 9, "2026-01-01"), (6, "p6", "human", ["look"], ["citation"], ["*"], "lee", 9, None), (7, "p7", "human", ["look"], ["citation"], ["*"], "lee", 9, None), (8, "p3", "declined", [], [], [], "lee", 0, None)]
    g = spark.createDataFrame(rows, "grant_id int, provider string, kind string, endpoints array<string>, payloads array<string>, callers array<string>, issuer string, daily_budget int, expires string").withColumn("expires", F.to_date("expires"))
    used = spark.createDataFrame([("p2", 5), ("p0", 2)], "provider string, used int")
    return consent.authorize(r, g, used, F.to_date(F.lit("2026-11-20"))).select("request_id", "allowed", "grant_id", F.array_join("refusals", "; ").alias("why"))


@query("""
WITH l AS (SELECT o_custkey AS r, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders)
SELECT k AS line_no, k % 6 = 2 AS dropped, CASE WHEN k % 6 IN (2, 3) THEN NULL ELSE CAST(200 + k % 2 AS INTEGER) END AS status FROM l
""")
def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers matched to request lines by place, else by the text echoed."""
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    line = F.concat(F.lpad(k.cast("string"), 8, "0"), F.lit(" F.3d 1"))
    lines = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("request_id"), k.alias("line_no"), line.alias("line"))
    at = lines.withColumn("start_index", (F.row_number().over(Window.partitionBy("request_id").orderBy("line_no")) - 1) * 16)
    m = F.col("line_no") % 6
    a = at.where(m != 3).select("request_id", F.when(m == 1, -1).otherwise(F.col("start_index")).alias("start_index"), F.when(m == 2, F.lit("9 U.S. 9")).otherwise(F.col("line")).alias("echo"), (F.col("line_no") % 2 + 200).cast("int").alias("status"))
    return lookups.match_lines(lines, a).select("line_no", "dropped", "status")


@query("""
SELECT o_orderkey AS line, CASE o_orderkey % 6 WHEN 0 THEN 'FOUND' WHEN 1 THEN 'NAME DIFFERS' WHEN 2 THEN 'NOT FOUND' WHEN 3 THEN 'AMBIGUOUS' WHEN 4 THEN 'FOUND' ELSE 'NOT LOOKED UP' END AS outcome,
  CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 4 THEN 2 END AS cluster_id, o_orderkey % 6 IN (0, 4) AND o_orderkey % 5 <> 0 AS year_differs FROM orders
""")
def lookup_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup answers judged by status, records and names."""
    m = F.col("o_orderkey") % 6
    rec = lambda i, n: F.struct(F.lit(i).cast("long").alias("id"), F.lit(n).alias("case_name"), F.lit("1999-04-01").alias("date_filed"))
    one, two, three = F.array(rec(1, "Twombly v. Bell Atlantic Corp.")), F.array(rec(1, "Smith v. Jones"), rec(2, "Twombly v. Acme")), F.array(rec(1, "Smith v. Jones"), rec(2, "Lee v. Acme"))
    d = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("line"), F.when(m == 1, "Garcia v. Lopez").otherwise("Bell Atl. Corp. v. Twombly").alias("draft_name"), F.when(F.col("o_orderkey") % 5 == 0, 1999).otherwise(2001).alias("year"),
        F.when(m == 2, 404).when(m == 3, 300).when(m == 4, 300).when(m == 5, 429).otherwise(200).alias("status"), F.when(m == 3, three).when(m == 4, two).when(m < 2, one).alias("clusters"),
    )
    return lookups.judge(d).select("line", "outcome", "cluster_id", "year_differs")
