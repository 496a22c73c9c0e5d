"""Operators of the record engine on small fixtures: table-driven cases, randomised equivalences, DuckDB per query."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.functions import dates as D
from lexmill.functions import strings as S
from lexmill.operators import court_days, custody, extraction, leaks, ledgers, lookups, machines, quotes, reporters, rulebooks
from lexmill.plans import catalog
from lexmill.sources import texts

day = dt.date.fromisoformat


@pytest.mark.parametrize(
    ("start", "days", "service", "due"),
    [
        ("2026-11-02", 14, "ecf", "2026-11-16"), ("2026-11-02", 12, "ecf", "2026-11-16"), ("2026-11-02", 13, "ecf", "2026-11-16"),
        ("2026-08-24", 14, "none", "2026-09-08"), ("2026-12-18", 14, "none", "2027-01-04"), ("2026-11-02", 14, "mail", "2026-11-19"),
        ("2026-11-02", 12, "mail", "2026-11-19"), ("2026-11-02", 10, "mail", "2026-11-16"), ("2026-11-09", 14, "mail", "2026-11-27"),
    ],
)
def test_deadlines(spark, start, days, service, due):
    t = spark.createDataFrame([(day(start), days, service)], "start date, days int, service string")
    years = spark.createDataFrame([(2026,), (2027,)], "year int")
    got = court_days.count_deadlines(t, court_days.calendar(spark, 2026, 2027), years).collect()[0]
    assert (got.due, got.refused) == (day(due), None)


def test_deadline_statutory_alternative_and_refusals(spark):
    cal, years = court_days.calendar(spark, 2026, 2028), spark.createDataFrame([(2026,), (2027,)], "year int")
    rows = [(day("2026-06-19"), 14, "ecf"), (day("2027-12-20"), 30, "ecf"), (day("2026-01-02"), 0, "ecf"), (day("2026-01-02"), 3, "fax"), (None, 3, "ecf")]
    got = court_days.count_deadlines(spark.createDataFrame(rows, "start date, days int, service string"), cal, years).collect()
    by = {(r.start, r.days, r.service): r for r in got}
    one = by[day("2026-06-19"), 14, "ecf"]
    assert (one.due, one.statutory_due) == (day("2026-07-06"), day("2026-07-03"))
    assert by[day("2027-12-20"), 30, "ecf"].refused.startswith("no complete list")
    assert by[day("2026-01-02"), 0, "ecf"].refused.startswith("days must")
    assert by[day("2026-01-02"), 3, "fax"].refused == "unknown service"
    assert by[None, 3, "ecf"].due is None


def test_holidays_of_a_year(spark):
    got = {r.day: r.name for r in court_days.federal_holidays(spark, 2021, 2021).collect()}
    assert got[day("2021-12-31")] == "New Year's Day (observed)" and got[day("2021-06-18")].endswith("(observed)")
    assert got[day("2021-05-31")] == "Memorial Day" and got[day("2021-11-25")] == "Thanksgiving Day"
    assert not [d for d in got if d.year != 2021]
    assert not court_days.federal_holidays(spark, 2020, 2020).where("name like 'Juneteenth%'").count()


def test_recorded_closures(spark):
    own = spark.createDataFrame([(day("2026-03-04"), "Flood", "closure")], "day date, name string, kind string")
    got = {r.day: r for r in court_days.calendar(spark, 2026, 2026, own).collect()}
    assert got[day("2026-03-04")].next_open == day("2026-03-05") and got[day("2026-03-04")].reason == "closure: Flood"
    assert got[day("2026-12-31")].next_open == day("2026-12-31")


@pytest.mark.parametrize(
    ("cite", "year", "code"),
    [
        ((0, "F.3d", 10), None, "volume-zero"), ((5, "f. 3d", 0), None, "page-zero"), ((1000, "F.3d", 1), None, "volume-past-end"),
        ((5000, "F.4th", 1), None, "volume-past-ceiling"), ((10, "F.3d", 1), 2040, "year-future"), ((10, "F.3d", 1), 1991, "year-before-start"),
        ((10, "F.3d", 1), 1992, None), ((10, "F.3d", 1), 2023, "year-after-end"), ((10, "F.3d", 1), 2022, None), ((9, "Z.", 1), 1800, None),
        ((900, "Fed. App'x", 1), None, "volume-past-end"), ((999, "L. Ed. 2d", 1), 2020, None),
    ],
)
def test_reporter_screen(spark, cite, year, code):
    c = spark.createDataFrame([(*cite, year)], "volume int, reporter string, page int, year int")
    assert reporters.screen(c, spark, F.to_date(F.lit("2026-11-20"))).collect()[0].code == code


def test_paren_year(spark):
    cases = {"2d Cir. 2007": 2007, "1999": 1999, "applying § 1983": None, "No. 1234": None, "S.D.N.Y. Mar. 5, 2001": 2001, "": None, "Tex. App.—Dallas 2010": 2010}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", reporters.paren_year(F.col("p")).alias("y")).collect()
    assert {r.p: r.y for r in got} == cases


def test_strings(spark):
    one = spark.createDataFrame([("x",)], "a string")
    f = lambda c: one.select(c.alias("v")).collect()[0].v
    assert f(S.normalize(F.lit("a\u00a0\u2009b \ufb01n\u200be\u2014x"))) == "a b fine-x"
    assert f(S.canonical_url(F.lit(" HTTP://Ex.COM/a/b//?q=1#z"))) == "http://ex.com/a/b?q=1"
    assert f(S.canonical_url(F.lit("https://ex.com"))) == "https://ex.com/"
    assert f(S.canonical_url(F.lit("mailto:a@b.c"))) is None
    assert f(S.authority_key(F.lit("42 U.S.C. § 5.1."))) == "42usc5.1"
    assert f(S.reporter_key(F.lit("Fed. App’x"))) == "fappx"
    assert f(S.ascii_digits(F.lit("٣९７"))) == "397"
    assert [tuple(r) for r in f(S.page_ranges(F.lit("45-7, 52, x, 101–3")))] == [(45, 47), (52, 52), (101, 103)]
    assert tuple(f(S.ref_parts(F.lit("a@b@c")))) == ("a", "b@c") and tuple(f(S.ref_parts(F.lit("a@b@c"), True))) == ("a@b", "c") and tuple(f(S.ref_parts(F.lit("a")))) == ("a", None)
    assert f(S.fact_label(F.lit(" documented "))) == "DOCUMENTED" and f(S.fact_label(F.lit("maybe"))) is None
    assert f(D.strict_date(F.lit("2026-2-3"))) is None and f(D.strict_date(F.lit("2026-02-30"))) is None and f(D.strict_date(F.lit("2026-02-28"))) == day("2026-02-28")
    assert f(S.plain_terminal(F.lit("## **A** `b` [c](d)"))) == "A b c"


def test_classify(spark):
    cases = {"Filings/plaintext/a.md": "filing", "x/evidence/a.eml": "evidence", "a.PDF": "filing", "b/c.wav": "media", "noext": "other", "a/.txt": "other", "admin/x": "admin", "research/media/x": "research"}
    got = spark.createDataFrame([(k,) for k in cases], "p string").select("p", custody.classify(F.col("p")).alias("k")).collect()
    assert {r.p: r.k for r in got} == cases


def test_register_and_verify(spark):
    f = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "3"), ("x", "9")], "rel_path string, sha256 string")
    known = spark.createDataFrame([("d", "0"), ("z", "2")], "rel_path string, sha256 string")
    got = {r.rel_path: r.outcome for r in custody.register(f, known, F.col("rel_path") == "x").collect()}
    assert got == {"a": "added", "b": "skipped", "c": "skipped", "d": "skipped", "x": "excluded"}
    stored = spark.createDataFrame([("a", "1"), ("b", "2"), ("q", "1"), ("../u", "1")], "rel_path string, sha256 string")
    got = {r.rel_path: r.verdict for r in custody.verify(stored, f).collect()}
    assert got == {"a": "ok", "b": "CHANGED", "q": "MISSING", "../u": "ESCAPED"}


def test_case_files(spark, tmp_path):
    for p, t in {"a.txt": "A", "sub/b.txt": "B", ".git/c": "C", "nested/d.txt": "D"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    nested = spark.createDataFrame([("nested",)], "root string")
    assert {r.rel_path for r in texts.case_files(spark, str(tmp_path), nested).collect()} == {"a.txt", "sub/b.txt"}


def test_machines_fold_in_order(spark):
    rows = [(1, 3, "mailed", "x"), (1, 1, "signed", None), (1, 2, "mailed", " "), (2, 1, "answered", None)]
    log = machines.run(spark.createDataFrame(rows, "target_id long, seq long, to_state string, evidence string"), machines.NOTICE)
    got = {(r.target_id, r.seq): (r.accepted, r.reason) for r in log.collect()}
    assert got == {(1, 1): (True, None), (1, 2): (False, "evidence is missing"), (1, 3): (True, None), (2, 1): (False, "draft can't become answered")}
    assert {r.target_id: r.state for r in machines.snapshot(log, machines.NOTICE).collect()} == {1: "mailed", 2: "draft"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("See 15 U.S.C. § 1681a(d), there.", [(4, 24, "us-code"), (14, 24, "section-sign")]),
        ("Miss. Code Ann. § 57-1-319.", [(0, 26, "state-ann"), (16, 26, "section-sign")]),
        ("347 U.S. 483", [(0, 12, "reporter")]),
        ("section 502 or 503", [(0, 18, "section"), (0, 11, "section"), (15, 18, "section")]),
        ("the § for", [(4, 9, "unparsed")]),
        ("Pub. L. 104-317 and H.R. 3763", [(0, 15, "public-law"), (20, 29, "bill")]),
        ("605.0101 - 605.1108", [(0, 19, "range")]),
        ("Cal. Bus. & Prof. Code § 17200 and Ohio Rev. Code Ann. § 5.2(a)", [(0, 30, "state-code"), (23, 30, "section-sign"), (35, 63, "state-ann"), (55, 63, "section-sign")]),
        ("12 C.F.R. § 1002.4, 8 Del. C. § 141, 735 Ill. Comp. Stat. 5/2-615", [(0, 18, "cfr"), (10, 18, "section-sign"), (20, 35, "delaware"), (30, 35, "section-sign"), (37, 65, "compiled")]),
        ("42 USC 1983; Fla. Stat. § 1.01; s. 3, ch. 99-4; chapters 4, 5 and 6", [(0, 11, "us-code"), (13, 30, "state-stat"), (24, 30, "section-sign"), (32, 46, "session-law"), (48, 67, "chapters"), (38, 46, "chapter")]),
        ("12 F.3d 34 and 5 F. Supp. 2d 6, section 4(a) of Title 9", [(0, 10, "reporter"), (15, 30, "reporter"), (32, 55, "section")]),
        ("", []),
        (None, []),
    ],
)
def test_extraction(text, want):
    assert sorted((a, b, k) for a, b, _, k, _ in extraction.cite_spans(text)) == sorted(want)


def test_claims_against_brute_force():
    rng = random.Random(0)
    for _ in range(300):
        claims, taken = extraction.Claims(), []
        for _ in range(25):
            a = rng.randint(0, 20)
            b = a + rng.randint(1, 8)
            free = all((a, b) != (c, d) and (b <= c or d <= a or (c <= a and b <= d) or (a <= c and d <= b)) for c, d in taken)
            assert claims.take(a, b) == free
            if free:
                taken.append((a, b))


def test_full_cites_agree_with_python(spark):
    rng = random.Random(2)
    reps = ["U.S.", "F.3d", "F. Supp. 2d", "So. 2d", "F.", "N.Y."]
    data = [(i, " ".join(f"{rng.randint(0, 999)} {rng.choice(reps)} {rng.randint(0, 99)}{rng.choice(['', ' (2d Cir. 2001)', ' (x)'])}{rng.choice([',', '.', ' é𝒳'])}" for _ in range(4))) for i in range(60)]
    got = {}
    for r in reporters.full_cites(spark.createDataFrame(data, "id int, t string"), "t", ["id"]).collect():
        got.setdefault(r.id, []).append((r.n, r.cite))
    for i, t in data:
        assert [c for _, c in sorted(got.get(i, []))] == [m[0] for m in re.finditer(reporters.CASE_CITE, t)]


def test_same_case(spark):
    rows = [
        ("Twombly", ["Bell Atlantic Corp. v. Twombly"], True), ("Roger v. Smith", ["Rogers v. Jones"], False), ("Roe v. Bd. of Educ.", ["Roe v. Board of Education of Topeka"], True),
        ("First Nat'l Bank v. Doe", ["Bank of Am. v. Roe"], False), ("EPA v. Doe", ["Environmental Protection Agency v. Doe"], True), ("", ["x"], True), (None, ["x"], True),
        ("Smith v. Jones", [], False), ("Smith v. Jones", None, False), ("Smith v. Jones", ["Lee v. Poe", None, "Jones v. Roe"], True),
    ]
    df = spark.createDataFrame(rows, "draft string, names array<string>, want boolean")
    assert [r.draft for r in df.where(lookups.same_case(F.col("draft"), F.col("names")) != F.col("want")).collect()] == []


def test_leaks(spark):
    text = "ok\n/Users/kim/x and C:\\Users\\lee\\y\n/home/user/z\nkim@law.org, git@github.com, a@b.md\n# userEmail\nkim@law.org leak-scan: allow SECRET"
    df = spark.createDataFrame([(1, text), (2, None)], "id int, t string")
    got = sorted((r.line_no, r.kind, r.detail) for r in leaks.scan(df, "t", ["id"], ["secret"]).collect())
    assert got == [(2, "home-path", "/Users/kim/x"), (2, "home-path", "C:\\Users\\lee\\y"), (4, "email", "kim@law.org"), (5, "session-transcript", "# userEmail"), (6, "case-pattern", "pattern #1")]


def test_quotes(spark):
    df = spark.createDataFrame([(1, 'He said “a\nb” and "c d" but "e\nf".'), (2, None)], "id int, t string")
    assert [r.quote for r in quotes.quotations(df, "t", ["id"]).orderBy("n").collect()] == ["a\nb", "c d"]
    pages = spark.createDataFrame([(7, 1, "The quick brown fox con-\ntinues. It concluded"), (7, 2, "that motion was denied"), (8, 1, "zz")], "doc int, page_number int, text string")
    q = [(1, 7, "quick … continues", [(1, 1)]), (2, 7, "conclud[ing] that", [(2, 2)]), (3, 7, "[M]otion [was] denied", [(1, 1)]), (4, 7, "nothing here", []), (5, 9, "x", []), (6, 7, "It concluded that motion", [(9, 9)])]
    got = {r.quote_id: (r.verdict, r.found_on) for r in quotes.verdicts(spark.createDataFrame(q, "quote_id int, doc int, quote string, pins array<struct<lo:bigint,hi:bigint>>"), pages).collect()}
    assert got[1] == ("exact", [1]) and got[2] == ("exact", [1, 2]) and got[4] == ("not-found", []) and got[5] == ("unchecked", []) and got[6] == ("wrong-page", [1, 2])


def test_sentences():
    t = 'Smith v. Jones, Inc. ruled. He left "A. B. C." Then Mr. Roe came! (See id. at 4.) Done'
    assert [t[a:b] for a, b in quotes.sentence_spans(t)][0] == "Smith v. Jones, Inc. ruled."
    assert quotes.sentence_spans("") == [] and quotes.sentence_spans("  ") == []


def test_sources(spark):
    assert texts.visible_text("<p>a <b>b</b></p><script>x<style>y</style></script><noscript>z</noscript>c &amp; d") == "a\nb\nc & d"
    assert texts.visible_text(None) is None
    p = texts.split_pages(spark.createDataFrame([(1, "a\fb\f \n"), (2, "c"), (3, "x<!-- pagebreak -->y")], "id int, t string"), "t").orderBy("id", "page_number").collect()
    assert [(r.id, r.page_number, r.page, r.n_pages) for r in p] == [(1, 1, "a", 2), (1, 2, "b", 2), (2, 1, "c", None), (3, 1, "x", 2), (3, 2, "y", 2)]
    log = spark.createDataFrame([('{"k": "a", "v": 1}', 1), ('{"k": "a", "v": 2}', 2), ('{"k": "b", "v"', 3)], "value string, line_no int")
    assert [tuple(r) for r in texts.append_log(log, "k string, v int", ["k"]).collect()] == [("a", 2, 2)]
    md = spark.createDataFrame([(1, "t\n| h | i |\n|---|---|\n| a | b \\| c |\nend")], "id int, t string")
    assert [r.cells for r in texts.markdown_tables(md, "t", "id").collect()] == [["a", "b | c"]]


def test_binding_units(spark):
    a = spark.createDataFrame([("d", "a-1", 1), ("d", "a-1-b", 2), ("d", "a-1-c", 4), ("d", "a-2", 6)], "doc string, anchor string, line int")
    assert {r.anchor: r.end_line for r in rulebooks.extents(a, "doc").collect()} == {"a-1": 6, "a-1-b": 4, "a-1-c": 6, "a-2": None}
    g = ledgers.gaps(spark.createDataFrame([("x", 3), ("x", 4), ("x", 9), ("y", 1)], "d string, n int"), "d", "n")
    assert sorted(tuple(r) for r in g.collect()) == [("x", 1, 2), ("x", 5, 8)]


def test_streaming_budget(spark, tmp_path):
    from lexmill.streaming import budgets

    rows = [("p", dt.datetime(2026, 1, 1, 5), "sent", "r1"), ("p", dt.datetime(2026, 1, 1, 6), "note", "r2"), ("p", dt.datetime(2026, 1, 2, 6), None, "r3"), ("p", dt.datetime(2026, 1, 2, 6), None, "r3")]
    log = spark.createDataFrame(rows, "provider string, ts timestamp, event string, request_id string")
    log.write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
    q = budgets.daily_use(stream).writeStream.format("memory").queryName("used").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("used").collect()) == sorted(tuple(r) for r in budgets.daily_use(log).collect()) == [("p", day("2026-01-01"), 1), ("p", day("2026-01-02"), 2)]
    q = budgets.without_replays(stream).writeStream.format("memory").queryName("once").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == budgets.without_replays(log).count() == 3


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, sf)
    c = con.execute(catalog.ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(d[0] for d in c.description)
    at = [[d[0] for d in c.description].index(x) for x in cols]
    flat = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted([tuple(flat(r[x]) for x in cols) for r in df.collect()], key=repr) == sorted([tuple(flat(r[i]) for i in at) for r in c.fetchall()], key=repr)


def test_brief_units_and_binding(spark):
    from lexmill.operators import authorities, brief

    t = "# Background\n\nHe left. See ECF No. 4 at 2.\n\n## Argument of fact\n\nStill open.\n\n# Argument\n\nClosed now."
    assert [(u["sentence"], u["heading"], u["fact_section"]) for u in brief.read_draft(t, authorities.Names())] == [
        ("# Background", True, False), ("He left. See ECF No. 4 at 2.", False, True), ("## Argument of fact", True, False),
        ("Still open.", False, True), ("# Argument", True, False), ("Closed now.", False, False),
    ]
    d = spark.createDataFrame([("d", "c", "Held, 550 U.S. at 5, 550 U.S. 544 (2007). Id. at 7. Under Rule 12(b) and Fed. R. Crim. P. 12. Rule 12. ECF No. 3. Id.")], "draft_id string, case_id string, text string")
    got = [(r.raw, r.group, r.target) for r in brief.bound(brief.cites(brief.units(d))).orderBy("unit_no", "n").collect()]
    assert got == [
        ("550 U.S. at 5", "authority", "550 us 544"), ("550 U.S. 544 (2007)", "authority", "550 us 544"), ("Id. at 7", "authority", "550 us 544"),
        ("Rule 12(b)", "authority", "rule:fedrcivp12"), ("Fed. R. Crim. P. 12", "authority", "rule:fedrcrimp12"), ("Rule 12", "authority", "rule:fedrcrimp12"),
        ("ECF No. 3", "record", "3"), ("Id.", "record", "3"),
    ]
