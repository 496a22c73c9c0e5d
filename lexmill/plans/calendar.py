"""Queries over court days and deadlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import court_days as C
from ..operators import cases, rulebooks, workspace
from ..session import table
from .registry import query

_HOL = """
WITH RECURSIVE y AS (SELECT unnest(range(1995, 2004)) AS y),
fx AS (SELECT make_date(y, m, d) AS day, name FROM y, (VALUES (1, 1, 'New Year''s Day'), (7, 4, 'Independence Day'), (11, 11, 'Veterans Day'), (12, 25, 'Christmas Day')) t(m, d, name)),
fl AS (SELECT make_date(y, m, 1) AS f, dow, nth, name, y, m FROM y, (VALUES (1, 1, 3, 'Birthday of Martin Luther King, Jr.'), (2, 1, 3, 'Washington''s Birthday'), (5, 1, -1, 'Memorial Day'), (9, 1, 1, 'Labor Day'), (10, 1, 2, 'Columbus Day'), (11, 4, 4, 'Thanksgiving Day')) t(m, dow, nth, name)),
fd AS (SELECT CASE WHEN nth > 0 THEN f + CAST((dow - isodow(f) + 7) % 7 + 7 * (nth - 1) AS INTEGER) ELSE last_day(f) - CAST((isodow(last_day(f)) - dow + 7) % 7 AS INTEGER) END AS day, name FROM fl),
h AS (SELECT CAST(day AS DATE) AS day, name, false AS observed FROM fx UNION ALL SELECT CAST(day AS DATE), name, false FROM fd
  UNION ALL SELECT CAST(CASE isodow(day) WHEN 6 THEN day - 1 ELSE day + 1 END AS DATE), name || ' (observed)', true FROM fx WHERE isodow(day) IN (6, 7)),
c AS (SELECT CAST(d AS DATE) AS day, isodow(d) >= 6 OR CAST(d AS DATE) IN (SELECT day FROM h) AS closed, isodow(d) >= 6 OR CAST(d AS DATE) IN (SELECT day FROM h WHERE NOT observed) AS closed_s FROM range(DATE '1995-01-01', DATE '2003-01-01', INTERVAL 1 DAY) t(d)),
n AS (SELECT day, min(CASE WHEN NOT closed THEN day END) OVER w AS nx, min(CASE WHEN NOT closed_s THEN day END) OVER w AS ns FROM c WINDOW w AS (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
"""


@query(_HOL + "SELECT day, name, observed FROM h WHERE year(day) BETWEEN 1995 AND 2002")
def federal_holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legal holidays and the weekdays kept for them."""
    return C.federal_holidays(spark, 1995, 2002)


@query(_HOL + "SELECT o_orderkey, nx AS next_open FROM orders JOIN n ON n.day = CAST(o_orderdate AS DATE)")
def next_open_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first open court day on or after each order's date."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return o.join(F.broadcast(C.calendar(spark, 1995, 2002)), "day").select("o_orderkey", "next_open")


@query(_HOL + """,
t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS start, CAST(o_orderkey % 30 AS INTEGER) AS days, CASE o_orderkey % 4 WHEN 0 THEN 'mail' WHEN 1 THEN 'ecf' WHEN 2 THEN 'none' ELSE 'pigeon' END AS service, CASE WHEN o_orderkey % 4 = 0 THEN 3 ELSE 0 END AS extra FROM orders),
a AS (SELECT t.*, n.nx AS n1, n.ns AS s1, start + days AS e FROM t LEFT JOIN n ON n.day = t.start + t.days AND t.days > 0),
b AS (SELECT a.*, CASE WHEN extra > 0 THEN x.nx ELSE n1 END AS due, CASE WHEN extra > 0 THEN z.ns ELSE s1 END AS sdue FROM a LEFT JOIN n x ON x.day = a.n1 + a.extra LEFT JOIN n z ON z.day = a.s1 + a.extra),
r AS (SELECT *, CASE WHEN days <= 0 THEN 'days must be a whole number above 0' WHEN service = 'pigeon' THEN 'unknown service' WHEN year(e) NOT BETWEEN 1995 AND 2000 OR due IS NULL OR year(due) NOT BETWEEN 1995 AND 2000 THEN 'no complete list of state holidays for a year reached' END AS refused FROM b)
SELECT o_orderkey, CASE WHEN refused IS NULL THEN CAST(due AS DATE) END AS due, CASE WHEN refused IS NULL THEN CAST(sdue AS DATE) END AS statutory_due, refused FROM r
""")
def deadline_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines counted from order dates; refusals are rows."""
    o = table(spark, sf_dir, "orders")
    service = F.when(F.col("o_orderkey") % 4 == 0, "mail").when(F.col("o_orderkey") % 4 == 1, "ecf").when(F.col("o_orderkey") % 4 == 2, "none").otherwise("pigeon")
    t = o.select("o_orderkey", F.to_date("o_orderdate").alias("start"), (F.col("o_orderkey") % 30).cast("int").alias("days"), service.alias("service"))
    years = spark.range(1995, 2001).select(F.col("id").cast("int").alias("year"))
    return C.count_deadlines(t, C.calendar(spark, 1995, 2002), years).select("o_orderkey", "due", "statutory_due", "refused")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN NULL WHEN o_orderkey % 5 = 2 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS due FROM orders
""")
def strict_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates read strictly: some are written with one-digit months, some with no such day."""
    o = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 5 == 1, F.date_format("o_orderdate", "yyyy-M-d'x'")).when(F.col("o_orderkey") % 5 == 2, F.date_format("o_orderdate", "yyyy-'13'-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", D.strict_date(text).alias("due"))


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS due, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-01') AS INTEGER) AS days_over
FROM orders WHERE o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) < DATE '1998-06-01'
""")
def overdue_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open deadlines before the day given."""
    today = F.to_date(F.lit("1998-06-01"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("due"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("met").alias("state"))
    return o.where(D.overdue(F.col("due"), F.col("state"), today)).select("o_orderkey", "due", F.date_diff(today, "due").alias("days_over"))


@query("""
WITH d AS (SELECT o_orderkey, CAST(date_diff('day', DATE '1998-06-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days_left FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, days_left, CASE WHEN days_left < 0 THEN 'overdue' ELSE 'due' END AS news,
  CASE WHEN days_left = 0 THEN 'due today' WHEN days_left > 0 THEN 'due in ' || days_left || CASE WHEN days_left = 1 THEN ' day' ELSE ' days' END ELSE -days_left || CASE WHEN days_left = -1 THEN ' day' ELSE ' days' END || ' overdue' END AS words
FROM d WHERE days_left < 0 OR days_left IN (0, 1, 3, 7)
""")
def deadline_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlines that make news on a day."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("due"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("met").alias("state"))
    return C.reminders(o, F.to_date(F.lit("1998-06-01"))).select("o_orderkey", "days_left", "news", D.day_words(F.col("days_left")).alias("words"))


@query("""
SELECT o_orderkey, CAST(date_diff('day', DATE '1998-06-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days_left FROM orders
WHERE o_orderstatus = 'O' AND date_diff('day', DATE '1998-06-01', CAST(o_orderdate AS DATE)) BETWEEN 0 AND 14
""")
def deadline_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open deadlines of the next two weeks."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("due"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("met").alias("state"))
    return cases.due_within(d, F.to_date(F.lit("1998-06-01")), 14).select("o_orderkey", "days_left")


@query("""
SELECT o_orderkey, b AS days_before, CAST(CAST(o_orderdate AS DATE) - b AS DATE) AS alarm_on FROM orders, (VALUES (7), (3), (1)) t(b) WHERE o_orderstatus = 'O'
""")
def deadline_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms before all-day events."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", F.to_date("o_orderdate").alias("due"))
    return C.alarms(o).select("o_orderkey", "days_before", "alarm_on")


@query(_HOL + """,
z AS (SELECT c.day, CASE WHEN isodow(c.day) >= 6 THEN 'weekend' ELSE coalesce((SELECT min(name) FROM h WHERE h.day = c.day AND NOT observed), (SELECT min(name) FROM h WHERE h.day = c.day AND observed)) END AS why, n.nx FROM c JOIN n ON n.day = c.day WHERE c.closed),
t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderkey % 9 + 1 AS INTEGER) AS k FROM orders), u AS (SELECT *, CAST(s + k AS DATE) AS l FROM t)
SELECT o_orderkey AS trigger_id, 'start ' || s || ', not counted; count ' || k || CASE WHEN k = 1 THEN ' day: ' ELSE ' days: ' END || l || coalesce('; ' || (SELECT string_agg(z.day || ' is closed (' || why || ')', '; ' ORDER BY z.day) FROM z WHERE z.nx = n.nx AND z.day >= l) || '; due ' || n.nx, '') AS steps
FROM u JOIN n ON n.day = l
""")
def count_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of a deadline's count in words, a reason for each day that it is rolled over."""
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trigger_id"), F.to_date("o_orderdate").alias("start"), (F.col("o_orderkey") % 9 + 1).cast("int").alias("days"))
    return workspace.count_steps(workspace.explained(t, C.calendar(spark, 1995, 2002)))


@query("""
WITH d(i, m) AS (VALUES (0, ''), (1, 'i'), (2, 'ii'), (3, 'iii'), (4, 'iv'), (5, 'v'), (6, 'vi'), (7, 'vii'), (8, 'viii'), (9, 'ix')), t(i, m) AS (VALUES (0, ''), (1, 'x'), (2, 'xx'), (3, 'xxx'), (4, 'xl'), (5, 'l'), (6, 'lx'), (7, 'lxx'), (8, 'lxxx'), (9, 'xc')),
o AS (SELECT o_orderkey, CAST(o_orderkey % 199 + 1 AS INTEGER) AS n FROM orders)
SELECT o_orderkey, n, repeat('c', n // 100) || t.m || d.m AS roman, repeat(chr(97 + (n - 1) % 26), (n - 1) // 26 + 1) AS alpha FROM o JOIN d ON d.i = n % 10 JOIN t ON t.i = n % 100 // 10
""")
def outline_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mark that a list's nth item has, in roman numbers and letters, for each order's place."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 199 + 1).cast("int").alias("n"))
    return o.join(F.broadcast(rulebooks.counters(spark)), "n").select("o_orderkey", "n", "roman", "alpha")
