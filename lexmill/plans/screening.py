"""Queries over reporter cites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reporters as R
from ..session import table
from .registry import query

_REPS = ["F.3d", "U.S.", "F. Supp. 3d", "So. 2d", "N.W.2d", "Z.9th"]
_TODAY = "2026-11-20"

_EXPECT = """
WITH c AS (SELECT o_orderkey, CAST(o_custkey % 1200 AS INTEGER) AS volume, CAST(o_orderkey % 6 AS INTEGER) AS r, CAST(o_orderkey % 997 AS INTEGER) AS page, CAST(1890 + o_orderkey % 140 AS INTEGER) AS y FROM orders),
s(r, name, first_year, last_year, last_volume, top) AS (VALUES (0, 'F.3d', 1993, 2021, 999, 999), (1, 'U.S.', 1754, NULL, NULL, 606 + CAST(floor(12 * (507 / 365.25 + 1)) AS INTEGER)),
  (2, 'F. Supp. 3d', 2014, NULL, NULL, 633 + CAST(floor(200 * (1207 / 365.25 + 1)) AS INTEGER)), (3, 'So. 2d', 1940, 2009, 999, 999), (4, 'N.W.2d', 1941, 2024, 999, 999)),
f AS (SELECT c.*, s.name AS series, CASE WHEN name IS NULL THEN NULL WHEN volume = 0 THEN 'volume-zero' WHEN page = 0 THEN 'page-zero'
  WHEN volume > top THEN CASE WHEN last_volume IS NOT NULL THEN 'volume-past-end' ELSE 'volume-past-ceiling' END
  WHEN y > 2026 THEN 'year-future' WHEN y < first_year - 1 THEN 'year-before-start' WHEN y > last_year + 1 THEN 'year-after-end' END AS code FROM c LEFT JOIN s USING (r))
"""


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rep = F.element_at(F.array(*[F.lit(x) for x in _REPS]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    text = F.concat(
        F.lit("See Roe v. Doe, "), (F.col("o_custkey") % 1200).cast("string"), F.lit(" "), rep, F.lit(" "), (F.col("o_orderkey") % 997).cast("string"),
        F.when(F.col("o_orderkey") % 2 == 0, " (2d Cir. ").otherwise(" ("), (F.col("o_orderkey") % 140 + 1890).cast("string"), F.lit("). So held."),
    )
    return o.select("o_orderkey", text.alias("text"))


@query(_EXPECT + "SELECT code, CASE WHEN code LIKE 'volume%' THEN 'NO SUCH VOLUME' WHEN code = 'page-zero' THEN 'NO SUCH PAGE' ELSE 'YEAR DOES NOT FIT' END AS label, count(*) AS cites FROM f WHERE code IS NOT NULL GROUP BY 1, 2")
def reporter_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: cites of composed drafts that can't exist, by reason. Drafts differ by their key alone."""
    found = R.screen_texts(_drafts(spark, sf_dir), "text", ["o_orderkey"], F.to_date(F.lit(_TODAY)))
    return found.groupBy("code", "label").agg(F.count("*").alias("cites"))


@query(_EXPECT + "SELECT o_orderkey, volume || ' ' || series || ' ' || page AS sent, code, CASE WHEN code LIKE 'volume%' THEN 'NO SUCH VOLUME' WHEN code = 'page-zero' THEN 'NO SUCH PAGE' ELSE 'YEAR DOES NOT FIT' END AS label, y AS year FROM f WHERE code IS NOT NULL")
def reporter_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings themselves."""
    return R.screen_texts(_drafts(spark, sf_dir), "text", ["o_orderkey"], F.to_date(F.lit(_TODAY)))


@query("""
SELECT o_orderkey, CAST(606 + floor(12 * (greatest(date_diff('day', DATE '2025-07-01', greatest(DATE '2026-11-10', CAST(DATE '2026-01-01' + CAST(o_orderkey % 900 AS INTEGER) AS DATE))), 0) / 365.25 + 1)) AS INTEGER) AS top FROM orders
""")
def volume_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How high a growing series' volumes can go by day."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("date_add(date'2026-01-01', cast(o_orderkey % 900 as int))").alias("today"))
    return o.withColumn("rep_key", F.lit("us")).join(F.broadcast(R.series(spark)), "rep_key").select("o_orderkey", R.ceiling(F.col("today")).alias("top"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN y WHEN 1 THEN y WHEN 2 THEN NULL WHEN 3 THEN y ELSE NULL END AS year FROM (SELECT o_orderkey, CAST(1900 + o_orderkey % 120 AS INTEGER) AS y FROM orders)
""")
def parenthetical_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year of a parenthetical, only where it is a court and date."""
    y = (F.col("o_orderkey") % 120 + 1900).cast("string")
    k = F.col("o_orderkey") % 5
    paren = F.when(k == 0, y).when(k == 1, F.concat(F.lit("5th Cir. "), y)).when(k == 2, F.concat(F.lit("applying § "), y)).when(k == 3, F.concat(F.lit("S.D.N.Y. Mar. 5, "), y)).otherwise(F.concat(F.lit("No. "), y))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.paren_year(paren).alias("year"))
