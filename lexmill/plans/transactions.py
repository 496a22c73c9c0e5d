"""Queries over commands that write several tables, composed from the given tables, with truth computed from keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import court_days
from ..operators import transactions as X
from ..session import table
from .calendar import _HOL
from .registry import query


def _k() -> Column:
    return F.col("o_orderkey")


def _own(c: Column) -> Column:
    return F.replace(c, F.lit("{k}"), _k().cast("string"))


_COMMAND = "seq bigint, op string, label string, due string, state string, verification string, confidence string, owner string, expected string, reason string, by string, sources array<string>, dry_run boolean"
#: The same commands over every deadline: JSON of each, and (accepted, reason, changes, event) that it must give. Deadlines
#: of odd keys are stored as open, due 2030-01-05, unverified, working-estimate, without owner; those of even keys aren't.
_STEPS = [
    ('{"seq":0,"op":"update","state":"met","by":"kim"}', (False, "reason is missing"), (False, "reason is missing")),
    ('{"seq":1,"op":"add","label":"Answer","due":"2030-01-05","by":"kim"}', (True, None), (False, "the id is taken")),
    ('{"seq":2,"op":"update","state":"done","reason":"x","by":"kim"}', (False, "unknown state"), (False, "unknown state")),
    ('{"seq":3,"op":"update","due":"2030-2-1","reason":"x","by":"kim"}', (False, "due is not a date"), (False, "due is not a date")),
    ('{"seq":4,"op":"update","state":"open","reason":"x","by":"kim"}', (False, "no change"), (False, "no change")),
    ('{"seq":5,"op":"update","state":"met","reason":"x","sources":["gone{k}.pdf@3"],"by":"kim"}', (False, "sources not registered: gone{k}.pdf"), (False, "sources not registered: gone{k}.pdf")),
    ('{"seq":6,"op":"update","state":"met","expected":"lapsed","reason":"x","by":"kim"}', (False, "expected lapsed, is open"), (False, "expected lapsed, is open")),
    ('{"seq":7,"op":"update","state":"vacated","reason":"x","by":"kim","dry_run":true}', (True, None), (True, None)),
    ('{"seq":8,"op":"update","due":"2030-02-01","owner":"court","expected":"open","reason":" ordered ","sources":["a{k}.pdf@4"],"by":"lee"}', (True, None), (True, None)),
    ('{"seq":9,"op":"update","reason":"x","by":"kim"}', (False, "nothing to update"), (False, "nothing to update")),
    ('{"seq":10,"op":"update","state":"met","due":"2030-02-01","reason":"filed","by":"kim"}', (True, None), (True, None)),
]


def _deadlines(spark: SparkSession, sf_dir: str) -> X.Written:
    o = table(spark, sf_dir, "orders")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, (j, *_) in enumerate(_STEPS)])
    c = o.select(_k().alias("target_id"), "o_orderkey", F.inline(steps)).select("target_id", F.from_json(_own(F.col("j")), _COMMAND).alias("c")).select("target_id", "c.*").withColumn("dry_run", F.coalesce("dry_run", F.lit(False)))
    none = F.lit(None).cast("string")
    stored = o.where("o_orderkey % 2 = 1").select(_k().alias("target_id"), F.lit("Reply").alias("label"), F.lit("2030-01-05").alias("due"), F.lit("open").alias("state"), F.lit("unverified").alias("verification"), F.lit("working-estimate").alias("confidence"), none.alias("owner"))
    return X.update_deadlines(stored, c, o.select(_own(F.lit("a{k}.pdf")).alias("rel_path")))


_OUTCOMES = ", ".join(f"({i}, {p}, {str(ok).lower()}, {'NULL' if why is None else repr(why)})" for i, (_, *both) in enumerate(_STEPS) for p, (ok, why) in enumerate(both))


@query(f"SELECT o_orderkey AS target_id, CAST(i AS BIGINT) AS seq, ok AS accepted, replace(why, '{{k}}', CAST(o_orderkey AS VARCHAR)) AS reason, CAST(CASE WHEN i IN (7, 10) THEN 1 WHEN i = 8 THEN 2 ELSE 0 END AS INTEGER) AS n_changes FROM orders JOIN (VALUES {_OUTCOMES}) t(i, p, ok, why) ON o_orderkey % 2 = p")
def deadline_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of commands over deadlines: added, changed, refused, tried; each sees what the one before left."""
    return _deadlines(spark, sf_dir).log.select("target_id", "seq", "accepted", "reason", F.size("changes").alias("n_changes"))


@query("SELECT o_orderkey AS target_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Answer' ELSE 'Reply' END AS label, '2030-02-01' AS due, 'met' AS state, 'unverified' AS verification, 'working-estimate' AS confidence, 'court' AS owner FROM orders")
def deadline_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines after the commands."""
    return _deadlines(spark, sf_dir).state


@query("""
SELECT o_orderkey AS target_id, CAST(s AS BIGINT) AS seq, 'deadline ' || o_orderkey || CASE s WHEN 1 THEN ' added: Answer due 2030-01-05 (working-estimate/unverified)' WHEN 8 THEN CASE WHEN o_orderkey % 2 = 0 THEN ' Answer' ELSE ' Reply' END || ': due 2030-01-05→2030-02-01; owner unset→court; reason: ordered'
  ELSE CASE WHEN o_orderkey % 2 = 0 THEN ' Answer' ELSE ' Reply' END || ': state open→met; reason: filed' END AS text, CASE WHEN s = 8 THEN 'lee' ELSE 'kim' END AS by, CASE WHEN s = 8 THEN 'a' || o_orderkey || '.pdf@4' ELSE '' END AS sources
FROM orders, (VALUES (1), (8), (10)) t(s) WHERE s <> 1 OR o_orderkey % 2 = 0
""")
def deadline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trail of the commands that took: fields with their old and new values, reasons, sources."""
    return _deadlines(spark, sf_dir).events.select("target_id", "seq", "text", "by", F.coalesce(F.array_join("sources", ","), F.lit("")).alias("sources"))


#: Commands over triggers; the fifth fires or, for keys divisible by three, withdraws.
_FIRE = "seq bigint, op string, on string, service string, reason string, by string, sources array<string>, dry_run boolean"


def _triggers(spark: SparkSession, sf_dir: str) -> X.Fired:
    o = table(spark, sf_dir, "orders")
    days = (_k() % 20 + 1).cast("int")
    t = o.select(_k().alias("target_id"), F.lit("Answer").alias("label"), F.lit("service").alias("waits_on"), days.alias("days"), F.when(_k() % 10 == 0, "withdrawn").otherwise("waiting").alias("state"), F.lit("Rule 12").alias("rule"), F.lit("ours").alias("owner"))
    steps = [
        '{"seq":0,"op":"fire","on":"1996-2-1","service":"none","reason":"r","sources":["a{k}@1"]}', '{"seq":1,"op":"fire","on":"{d}","service":"pigeon","reason":"r","sources":["a{k}@1"]}',
        '{"seq":2,"op":"fire","on":"{d}","service":"none","reason":" ","sources":["a{k}@1"]}', '{"seq":3,"op":"fire","on":"{d}","service":"none","reason":"r","sources":["b{k}@1"]}',
        '{"seq":4,"op":"fire","on":"{d}","service":"none","dry_run":true}', '{"seq":5,"op":"fire","on":"{d}","service":"mail","reason":"served","by":"kim","sources":["a{k}@1"]}',
        '{"seq":6,"op":"fire","on":"{d}","service":"none","reason":"r","sources":["a{k}@1"]}', '{"seq":7,"op":"withdraw","reason":"moot"}',
    ]
    read = lambda j: F.from_json(F.lit(j), _FIRE)
    five = F.when(_k() % 3 == 0, read('{"seq":5,"op":"withdraw","reason":"moot","by":"kim"}')).otherwise(read(steps[5]))
    # Each command's JSON is read once; the order's day and key are set in its fields.
    c = o.select(_k().alias("target_id"), "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.inline(F.array(*[five if i == 5 else read(j) for i, j in enumerate(steps)])))
    c = c.withColumns({"on": F.replace("on", F.lit("{d}"), F.col("d")), "sources": F.coalesce(F.transform("sources", _own), F.array().cast("array<string>"))}).drop("o_orderkey", "d")
    years = spark.range(1995, 2003).select(F.col("id").cast("int").alias("year"))
    return X.fire_triggers(t, c, o.select(_own(F.lit("a{k}")).alias("rel_path")), court_days.calendar(spark, 1995, 2002), years, F.to_date(F.lit("2002-01-01")))


_DUE = _HOL + """,
u AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderkey % 20 + 1 AS INTEGER) AS k FROM orders),
v AS (SELECT u.*, a.nx AS plain, b.nx AS mail FROM u LEFT JOIN n a ON a.day = s + k LEFT JOIN n b ON b.day = a.nx + 3),
w AS (SELECT *, year(s + k) >= 1995 AND year(plain) >= 1995 AND plain IS NOT NULL AS inside, year(s + k) >= 1995 AND mail IS NOT NULL AS inside_mail FROM v)
"""


@query(_DUE + """
SELECT o_orderkey AS target_id, CAST(i AS BIGINT) AS seq, why IS NULL AS accepted, why AS reason, CASE WHEN why IS NULL AND i = 4 THEN plain WHEN why IS NULL AND i = 5 AND o_orderkey % 3 <> 0 THEN mail END AS due FROM (
  SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN 'already withdrawn' WHEN i = 0 THEN 'not a date' WHEN i = 1 THEN 'unknown service' WHEN i IN (2, 3, 4, 6) AND NOT inside THEN 'no complete list of state holidays for a year reached'
    WHEN i = 2 THEN 'reason is missing' WHEN i = 3 THEN 'sources not registered: b' || o_orderkey WHEN i = 5 AND o_orderkey % 3 <> 0 AND NOT inside_mail THEN 'no complete list of state holidays for a year reached'
    WHEN i > 5 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'already withdrawn' ELSE 'already fired on ' || s END END AS why FROM w, range(0, 8) t(i))
""")
def trigger_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of commands over triggers: the first fit one takes it, a dry run takes nothing."""
    return _triggers(spark, sf_dir).log


@query(_DUE + """
SELECT 'd_' || left(sha256('trigger|' || o_orderkey), 12) AS target_id, 'Answer' AS label, CAST(mail AS VARCHAR) AS due, 'open' AS state, 'unverified' AS verification, 'working-estimate' AS confidence, 'ours' AS owner FROM w WHERE o_orderkey % 10 <> 0 AND o_orderkey % 3 <> 0 AND inside_mail
""")
def fired_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines that fired triggers make."""
    return _triggers(spark, sf_dir).deadlines


@query(_DUE + """,
f AS (SELECT *, 'd_' || left(sha256('trigger|' || o_orderkey), 12) AS d FROM w WHERE o_orderkey % 10 <> 0 AND (o_orderkey % 3 = 0 OR inside_mail))
SELECT o_orderkey AS target_id, CAST(1 AS INTEGER) AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'trigger ' || o_orderkey || ' Answer: state waiting→withdrawn; reason: moot' ELSE 'deadline ' || d || ' added: Answer due ' || mail || ' (working-estimate/unverified); rule: Rule 12; owner: ours; from trigger ' || o_orderkey END AS text FROM f
UNION ALL SELECT o_orderkey, 2, 'trigger ' || o_orderkey || ' Answer fired: service on ' || s || ', service: mail; deadline ' || d || ' due ' || mail || '; reason: served' FROM f WHERE o_orderkey % 3 <> 0
""")
def trigger_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trail of triggers that fired or were withdrawn."""
    return _triggers(spark, sf_dir).events.select("target_id", "n", "text")


_CAND = """
WITH c AS (SELECT o_custkey AS brief_id, o_orderkey AS seq, o_orderkey % 300 AS site, o_orderkey % 41 = 0 AS blank, o_orderkey % 13 = 1 AS guessed, CASE WHEN o_orderkey % 7 = 0 THEN '1998-01-01' WHEN o_orderkey % 7 = 1 THEN 'lately' ELSE '1998-05-20' END AS got,
  CASE WHEN o_orderkey % 2 = 0 THEN 'form' ELSE 'portal' END AS dest, o_orderkey % 5 = 0 AS verb FROM orders),
a AS (SELECT *, brief_id IN (SELECT brief_id FROM c WHERE blank) AS aborted FROM c),
g AS (SELECT *, 'or_' || left(sha256('https://site' || site || '.org/in'), 12) AS rid FROM a WHERE NOT aborted AND NOT guessed),
f AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY brief_id, seq) AS i, count(*) OVER (PARTITION BY rid) AS n FROM g)
"""


def _merge(spark: SparkSession, sf_dir: str) -> X.Merged:
    o = table(spark, sf_dir, "orders")
    site = _k() % 300
    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    cand = o.select(
        F.col("o_custkey").alias("brief_id"), _k().alias("seq"), F.when(_k() % 41 == 0, " ").otherwise(t("Firm ", _k())).alias("name"), t("Org ", F.floor(site / 2)).alias("org"), F.lit("form").alias("intake_channel"),
        t("HTTPS://Site", site, ".org/in/#x").alias("intake_url"), t("https://list.org/", _k()).alias("source_url"), F.lit("near").alias("match_reason"),
        F.when(_k() % 7 == 0, "1998-01-01").when(_k() % 7 == 1, "lately").otherwise("1998-05-20").alias("retrieved_at"), (_k() % 5 == 0).alias("verbatim"), F.when(_k() % 13 == 1, t("x", _k(), "@firm.org")).alias("email"), F.lit("write to us").alias("quoted"),
        F.when(_k() % 2 == 0, "form").otherwise("portal").alias("destination_type"),
    )
    s = o.select((_k() % 300).alias("id")).distinct()
    url = F.concat(F.lit("https://site"), F.col("id").cast("string"), F.lit(".org/in"))
    stored = s.where("id % 3 = 0").select(
        F.concat(F.lit("or_"), F.substring(F.sha2(url, 256), 1, 12)).alias("recipient_id"), url.alias("intake_url"), F.when(F.col("id") % 9 == 0, "declined").when(F.col("id") % 9 == 3, "simulated").otherwise("candidate").alias("status"), F.when(F.col("id") % 2 == 0, "email").otherwise("unknown").alias("destination_type"),
        F.lit("1998-03-01").alias("retrieved_at"), F.array(F.lit("old")).alias("flags"), F.concat(F.lit("Old "), F.col("id").cast("string")).alias("name"), F.lit(None).cast("string").alias("org"), F.lit("mail").alias("intake_channel"), F.lit("was").alias("match_reason"), F.lit("https://old.org").alias("source_url"),
    )
    stop = s.where("id % 10 = 1").select(url.alias("intake_url"), F.lit("opted_out").alias("reason"))
    return X.merge_briefs(cand, stored, stop, F.to_date(F.lit("1998-06-01")))


@query(_CAND + """,
s AS (SELECT DISTINCT o_orderkey % 300 AS id FROM orders), st AS (SELECT id, CASE WHEN id % 9 = 0 THEN 'declined' WHEN id % 9 = 3 THEN 'simulated' ELSE 'candidate' END AS status, CASE WHEN id % 2 = 0 THEN 'email' END AS dest FROM s WHERE id % 3 = 0),
b AS (SELECT coalesce(f.site, st.id) AS id, st.id IS NULL AS new, f.site IS NOT NULL AS come, st.status, st.dest AS old, f.* EXCLUDE (site), coalesce(f.site, st.id) % 10 = 1 AS stop FROM (SELECT * FROM f WHERE i = 1) f FULL JOIN st ON st.id = f.site),
r AS (SELECT *, NOT new AND (status = 'declined' OR stop) AS closed, NOT new AND NOT stop AND status = 'simulated' AS contact FROM b)
SELECT 'or_' || left(sha256('https://site' || id || '.org/in'), 12) AS recipient_id, CASE WHEN new THEN CASE WHEN stop THEN 'opted_out' ELSE 'candidate' END WHEN closed OR contact OR NOT come THEN status ELSE 'candidate' END AS status,
  CASE WHEN come AND NOT closed THEN coalesce(old, dest) ELSE coalesce(old, 'unknown') END AS destination_type, CASE WHEN come AND NOT closed THEN got ELSE '1998-03-01' END AS retrieved_at, CASE WHEN come AND NOT closed AND NOT contact THEN 'Firm ' || seq ELSE 'Old ' || id END AS name,
  array_to_string(list_sort(list_filter(CASE WHEN come AND NOT closed THEN [CASE WHEN verb THEN 'verbatim-unverified' END, CASE WHEN got = '1998-01-01' THEN 'stale-evidence' END, CASE WHEN got = 'lately' THEN 'unparsed-retrieved-at' END, CASE WHEN old <> dest THEN 'conflict:destination-mismatch' END, CASE WHEN n > 1 THEN 'duplicate-channel' END]
    ELSE ['old', CASE WHEN come AND n > 1 THEN 'duplicate-channel' END] END, lambda x: x IS NOT NULL)), ',') AS flags FROM r
""")
def outreach_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipients after research briefs: new, refreshed, in contact, closed; flags without those of organisations."""
    r = _merge(spark, sf_dir).recipients
    return r.select("recipient_id", "status", "destination_type", "retrieved_at", "name", F.array_join(F.array_remove("flags", "conflict:intake-mismatch"), ",").alias("flags"))


@query(_CAND + """
SELECT a.brief_id, a.seq, CASE WHEN a.aborted THEN 'aborted' WHEN a.guessed THEN 'rejected' WHEN a.site % 3 <> 0 AND f.i = 1 THEN 'imported' ELSE 'reused' END AS outcome, CASE WHEN a.aborted THEN 'brief aborted' WHEN a.guessed THEN 'address is not quoted from the source' END AS reason FROM a LEFT JOIN f USING (brief_id, seq)
""")
def outreach_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each candidate: all of a brief or none."""
    return _merge(spark, sf_dir).report.select("brief_id", "seq", "outcome", "reason")


@query(_CAND + "SELECT rid AS recipient_id, count(*) AS n, count(*) FILTER (WHERE verb) AS verbatim, min(seq) AS first_seq FROM g GROUP BY 1")
def outreach_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence that a merge appends, by recipient."""
    return _merge(spark, sf_dir).evidence.groupBy("recipient_id").agg(F.count("*").alias("n"), F.count_if("verbatim").alias("verbatim"), F.min("seq").alias("first_seq"))
