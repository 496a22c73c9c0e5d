"""Queries over cases, subcases and their lists, composed from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cases as C
from ..operators import leaks, quotes
from ..session import table
from .registry import query


def _k() -> Column:
    return F.col("o_orderkey")


def _c() -> Column:
    return F.col("o_custkey")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


def _t(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("""
WITH RECURSIVE e AS (SELECT user_id AS c, event_id AS q, ['propose', 'activate', 'decline', 'revoke', 'default'][(event_id * 7 + event_id // 11) % 5 + 1] AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f(c, i, p, g, d, x) AS (SELECT DISTINCT c, CAST(0 AS BIGINT), 0, false, false, false FROM e
  UNION ALL SELECT e.c, e.i, CASE op WHEN 'propose' THEN p + 1 WHEN 'default' THEN p ELSE 0 END, CASE op WHEN 'activate' THEN true WHEN 'decline' THEN false WHEN 'revoke' THEN false ELSE g END,
    CASE op WHEN 'default' THEN d OR NOT (g OR x) WHEN 'propose' THEN d ELSE false END, CASE op WHEN 'activate' THEN false WHEN 'decline' THEN true ELSE x END FROM f JOIN e ON e.c = f.c AND e.i = f.i + 1)
SELECT c AS case_id, 'p' AS provider, arg_max(p, i) AS proposals, arg_max(g, i) AS granted, arg_max(d, i) AS by_default, arg_max(x, i) AS declined FROM f GROUP BY c
""")
def grant_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants, defaults, refusals and proposals after each case's log."""
    e = F.col("event_id")
    op = F.element_at(F.array(*[F.lit(x) for x in ("propose", "activate", "decline", "revoke", "default")]), ((e * 7 + F.floor(e / 11)) % 5 + 1).cast("int"))
    return C.grant_records(table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.lit("p").alias("provider"), e.alias("seq"), op.alias("op")))


def _attached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every order a subcase of its customer's case, but those of keys divisible by eight; documents a to e of the parents."""
    o = _orders(spark, sf_dir).select(_t("s", _k()).alias("case_id"), _t("c", _c()).alias("parent_id"), _k().alias("k"))
    m = F.col("k") % 8
    ref = F.element_at(F.array(*[F.lit(x) for x in ("parent:a@1", "parent:a@1", "parent:b@2", "parent:c@3", "parent:d@4", "parent:e", "own@5", "gone")]), (m + 1).cast("int"))
    asked = o.select("case_id", F.col("k").alias("fact_id"), ref.alias("ref")).unionByName(o.where(m == 1).select("case_id", (-F.col("k")).alias("fact_id"), F.lit("parent:a@9").alias("ref")))
    p = o.select(F.col("parent_id").alias("case_id")).distinct()
    up = p.select("case_id", F.inline(F.array(*[F.struct(F.lit(n).alias("rel_path"), F.lit(f"h{n}").alias("sha256")) for n in "abde"])))
    own = o.select("case_id", F.lit("own").alias("rel_path"), F.lit("ho").alias("sha256"))
    copy = o.where(m == 4).select("case_id", F.lit("copy").alias("rel_path"), F.lit("hd").alias("sha256"))
    other = o.where(m == 5).select("case_id", F.lit("parent:e").alias("rel_path"), F.lit("old").alias("sha256"))
    now = up.where("rel_path <> 'x'").withColumn("sha256", F.when(F.col("rel_path") == "b", "new").otherwise(F.col("sha256")))
    return C.attach_sources(asked, up.unionByName(own).unionByName(copy).unionByName(other), o.where(m != 0).select("case_id", "parent_id"), now)


@query("""
SELECT 's' || o_orderkey AS case_id, o_orderkey AS fact_id, ['', 'parent:a', '', '', 'copy', '', 'own', ''][o_orderkey % 8 + 1] AS rel_path, CASE WHEN o_orderkey % 8 IN (5, 7) THEN NULL ELSE ['1', '1', '2', '3', '4', '', '5', ''][o_orderkey % 8 + 1] END AS locator,
  ['not a subcase', '', 'changed', 'not registered', '', 'registered here with other bytes', '', 'not registered'][o_orderkey % 8 + 1] AS refused FROM orders
UNION ALL SELECT 's' || o_orderkey, -o_orderkey, 'parent:a', '9', '' FROM orders WHERE o_orderkey % 8 = 1
""")
def parent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts' sources in their own case or its parent: linked, or refused with the reason."""
    none = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return _attached(spark, sf_dir)[0].select("case_id", "fact_id", none("rel_path"), "locator", none("refused"))


@query("SELECT 's' || o_orderkey AS case_id, 'parent:a' AS rel_path, 'ha' AS sha256 FROM orders WHERE o_orderkey % 8 = 1")
def parent_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to parents' documents that are entered in subcases, once each."""
    return _attached(spark, sf_dir)[1]


@query("""
WITH d AS (SELECT o_custkey AS c, count(*) FILTER (WHERE o_orderstatus = 'O') AS n, count(*) FILTER (WHERE o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) < DATE '1997-06-01') AS l FROM orders GROUP BY 1)
SELECT c_nationkey AS parent_id, c_custkey AS case_id, '- n' || c_custkey || ' — ' || CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'n' || c_custkey END || ' · Open deadlines: ' || coalesce(n, 0) || ' · ' || CASE WHEN l > 0 THEN '⚠ ' ELSE '' END || 'OVERDUE: ' || coalesce(l, 0) AS line
FROM customer LEFT JOIN d ON c = c_custkey
""")
def subcase_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each subcase with its open and overdue deadlines."""
    k = F.col("c_custkey")
    kids = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("parent_id"), k.alias("case_id"), _t("n", k).alias("name"), F.when(k % 2 == 0, F.col("c_name")).alias("title"))
    d = _orders(spark, sf_dir).select(_c().alias("case_id"), F.to_date("o_orderdate").alias("due"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("met").alias("state"))
    return C.child_status(kids, d, F.to_date(F.lit("1997-06-01")))


@query("""
SELECT o_orderkey AS case_id, 'consent' AS kind, CASE WHEN o_orderkey % 4 = 0 THEN 'p' || o_custkey || ':human' WHEN o_orderkey % 4 = 1 THEN NULL END AS item, CASE WHEN o_orderkey % 4 IN (2, 3) THEN 'no grants in it' END AS refused FROM orders
UNION ALL SELECT o_orderkey, 'attachments', CASE WHEN o_orderkey % 4 = 0 THEN 'fed' || o_custkey || ':1' END, CASE WHEN o_orderkey % 4 <> 0 THEN 'no packs in it' END FROM orders
UNION ALL SELECT o_orderkey, 'manifest', CASE WHEN o_orderkey % 4 = 0 THEN '../..:T' || o_custkey END, CASE WHEN o_orderkey % 4 <> 0 THEN 'no parent in it' END FROM orders
""")
def sidecar_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consent, attachments and manifests out of JSON; another shape is refused whole."""
    m, c = _k() % 4, _c().cast("string")
    o = _orders(spark, sf_dir)

    def read(kind: str, texts: list[Column], item: Column) -> DataFrame:
        j = F.when(m == 0, texts[0]).when(m == 1, texts[1]).when(m == 2, texts[2]).otherwise(texts[3])
        rows = C.sidecars(o.select(_k().alias("case_id"), j.alias("json")), kind)
        return rows.select("case_id", F.lit(kind).alias("kind"), F.when(F.col("refused").isNull(), item).alias("item"), "refused")

    x = F.lit
    consent = read("consent", [F.concat(x('{"grants":[{"provider":"p'), c, x('","kind":"human"}]}')), x('{"grants":[]}'), x('{"grants":{}}'), x('{"grants":[')], F.when(F.col("provider").isNotNull(), F.concat_ws(":", "provider", "kind")))
    packs = read("attachments", [F.concat(x('{"packs":[{"id":"fed'), c, x('","version":"1"}]}')), x("[]"), x('{"packs":"a"}'), x(None).cast("string")], F.concat_ws(":", "id", "version"))
    manifest = read("manifest", [F.concat(x('{"parent":"../..","title":"T'), c, x('"}')), x('{"parent":" "}'), x('{"title":"T"}'), x("no")], F.concat_ws(":", "parent", "title"))
    return consent.unionByName(packs).unionByName(manifest)


@query("""
SELECT o_orderkey, CAST(o_orderdate AS DATE) || '  Order ' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN ' (hard/unverified)' ELSE '' END || '  [' || CASE WHEN o_orderkey % 3 = 0 THEN '—' ELSE 'Rule 12' END || ']' || CASE WHEN o_orderkey % 5 = 0 THEN '  owner=ours' ELSE '' END || '  state=open' || CASE WHEN CAST(o_orderdate AS DATE) < DATE '1997-06-01' THEN '  ⚠ OVERDUE' ELSE '' END AS line
FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 5 = 0
""")
def deadline_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the open deadlines of one owner."""
    d = _orders(spark, sf_dir).select(
        "o_orderkey", F.to_date("o_orderdate").alias("due"), _t("Order ", _c()).alias("label"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("met").alias("state"), F.when(_k() % 2 == 0, "unverified").otherwise("verified-official").alias("verification"),
        F.lit("hard").alias("confidence"), F.when(_k() % 3 != 0, "Rule 12").alias("rule"), F.when(_k() % 5 == 0, "ours").alias("owner"),
    )
    return C.select_deadlines(d, owner="ours").select("o_orderkey", C.deadline_line(F.to_date(F.lit("1997-06-01")), True).alias("line"))


@query("""
SELECT year, seq, CASE WHEN year > 2200 THEN 'not a year' WHEN seq % 3 = 0 THEN 'jurisdiction is missing' WHEN year % 2 = 0 OR seq <> min(CASE WHEN seq % 3 <> 0 THEN seq END) OVER (PARTITION BY year) THEN 'recorded already' END AS refused
FROM (SELECT CAST(2000 + o_orderkey % 300 AS INTEGER) AS year, o_orderkey AS seq FROM orders)
""")
def holiday_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years whose lists of holidays are said to be complete: recorded once."""
    y = (_k() % 300 + 2000).cast("int")
    asked = _orders(spark, sf_dir).select(y.alias("year"), _k().alias("seq"), F.when(_k() % 3 == 0, " ").otherwise("Ohio").alias("jurisdiction"))
    return C.register_years(asked.select("year").distinct().where("year % 2 = 0"), asked)


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 7 AS m, (o_orderkey % 50 + 1) || ' U.S.C. § ' || (o_custkey + 1) AS u FROM orders)
SELECT o_orderkey, CASE m WHEN 0 THEN u WHEN 1 THEN u || '(a)(2)' WHEN 2 THEN u WHEN 3 THEN u || '(b)' END AS sent FROM o
""")
def statute_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a statute lookup sends: one cite and nothing else."""
    u, m = _t(_k() % 50 + 1, " U.S.C. § ", _c() + 1), _k() % 7
    t = (
        F.when(m == 0, F.concat(F.lit(" "), u)).when(m == 1, F.concat(u, F.lit("(a)(2)"))).when(m == 2, F.concat(u, F.lit(" (2018)"))).when(m == 3, F.concat(u, F.lit("(b) (West 2019)"))).when(m == 4, F.concat(u, F.lit(" and more")))
        .when(m == 5, F.lit("550 U.S. 544")).otherwise(F.concat(u, F.lit("\nx")))
    )
    return C.statute_payload(_orders(spark, sf_dir).select("o_orderkey", t.alias("text")), "text", ["o_orderkey"])


@query("""
SELECT o_orderkey, sha256('{"a": ' || o_orderkey || ', "b": ' || CASE WHEN o_orderkey % 2 = 0 THEN 'null' ELSE '"é \\"' || o_custkey || '\\""' END || ', "c": ' || CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END || '}') AS sha FROM orders
""")
def spaced_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of records in the spaced canonical form."""
    r = _orders(spark, sf_dir).select("o_orderkey", (_k() % 3 == 0).alias("c"), F.when(_k() % 2 == 1, F.concat(F.lit('é "'), _c().cast("string"), F.lit('"'))).alias("b"), _k().alias("a"))
    return r.select("o_orderkey", F.sha2(C.spaced_json(["c", "a", "b"]), 256).alias("sha"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'né ' || o_custkey WHEN 1 THEN 'plain ' || o_custkey END AS text FROM orders")
def decoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as text: UTF-16 by its mark, UTF-8, none for binary ones."""
    wide = F.concat(F.lit(b"\xff\xfe"), F.encode(_t("né ", _c()), "UTF-16LE"))
    content = F.when(_k() % 3 == 0, wide).when(_k() % 3 == 1, F.encode(_t("plain ", _c()), "UTF-8")).otherwise(F.lit(b"a\x00b"))
    return _orders(spark, sf_dir).select("o_orderkey", content.alias("content")).select("o_orderkey", leaks.decoded(F.col("content")).alias("text"))


@query("SELECT o_orderkey, ' the fi2st of ' || o_custkey || ' it''s word joined ' AS words FROM orders")
def composed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word stream of texts with ligatures, superscripts, wide letters and a word cut at a line's end."""
    t = _t("The “\ufb01²st” of ", _c(), " — it’s ｗｏｒｄ joi-\nned.")
    rows = quotes.compose(_orders(spark, sf_dir).select("o_orderkey", t.alias("text")), "text")
    return rows.select("o_orderkey", quotes.word_stream(F.col("text")).alias("words"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 5")
def first_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five rows of each group, as lists show them."""
    return C.first_of_each(_orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5).select("o_custkey", "o_orderkey")
