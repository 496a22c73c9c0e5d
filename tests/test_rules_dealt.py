"""Rules texts are dealt to tasks before their marks are read."""

from lexmill.operators import outline, rulebooks


def test_texts_of_one_partition_are_read_in_several_tasks(spark):
    texts = spark.createDataFrame([(i, f"Rule {i}. Form\n(a) One\n  (1) Two\n(b) Three") for i in range(1, 9)], "source_id int, text string").coalesce(1)
    out = rulebooks.sections(texts)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "RepartitionByExpression" in plan or "REPARTITION_BY_NUM" in plan
    assert "REPARTITION_BY_NUM" in plan[plan.index("ArrowEvalPython") :]
    assert {(r.source_id, r.anchor) for r in out.where("line_no = 2").collect()} == {(i, f"{i}-a-1") for i in range(1, 9)}


def test_a_mark_in_two_lists_still_parts_the_readings():
    marks = [(c, 0) for c in "abcdefgh"] + [("1", 4), ("i", 8), ("i", 0), ("ii", 8)]
    paths = [p for p, _ in outline.place(marks)]
    assert paths[8] == ("h", "1") and paths[10] == ("i",)


def test_marks_are_read_once_and_after_the_texts_are_dealt(spark):
    from lexmill.sources import bundles

    texts = spark.createDataFrame([(i, f"Rule {i}. Form\n(a) One\n  (1) Two\n(b) Three") for i in range(1, 9)], "source_id int, text string").coalesce(1)
    meta = "'rules-1' format, 'p' || source_id id, '1' version, 'T' title, 'L. R.' cite_prefix, 'lr' anchor_prefix, cast(null as string) current_as_of, 365 review_after_days"
    packs = bundles.pack_bodies(rulebooks.read(texts).selectExpr("source_id", "lines", *meta.split(", ")), "source_id")
    found, refused = bundles.load_packs(packs, "source_id", "rules-1")
    for df in (rulebooks.sections(texts), found, refused):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
        assert "REPARTITION_BY_NUM" in plan[plan.index("ArrowEvalPython") :]
    assert {(r.source_id, r.anchor) for r in found.collect()} == {(i, f"lr-{i}{x}") for i in range(1, 9) for x in ("", "-a", "-a-1", "-b")}
    assert refused.count() == 0


def test_page_numbers_stand_alone_at_a_pages_top_or_foot(spark):
    pages = ["iv\nRule 1. Form\n 12 \n\n", "\t\n- 3 -\r\n(a) One\n4\nmore\nPage 5", "6\n7\n(b) Two\n8 9", "10", "\n (i)\n2 of\t9"]
    text = "\f".join(pages)
    got = [(r.line_no, r.anchor, r.line) for r in rulebooks.sections(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "12\f")], "source_id int, text string")).orderBy("line_no").collect()]
    assert got == [(1, "1", "Rule 1. Form"), (7, "1-a", "(a) One"), (8, "1-a", "4"), (9, "1-a", "more"), (12, "1-a", "7"), (13, "1-b", "(b) Two"), (14, "1-b", "8 9"), (17, "1-b", "(i)")]
    kept = {r.source_id: (r.words == r.kept, r.whole) for r in rulebooks.kept_words(rulebooks.read(spark.createDataFrame([(1, text), (2, None)], "source_id int, text string"))).collect()}
    assert kept[2] == (True, True)


def test_bytes_that_are_not_text_do_not_end_the_reading(spark):
    raw = spark.createDataFrame([(1, b"Rule 1. \xff\n(a) \xc3(\n(b) Two")], "source_id int, raw binary").selectExpr("source_id", "cast(raw as string) text")
    assert [(r.line_no, r.anchor) for r in rulebooks.sections(raw).orderBy("line_no").collect()] == [(0, "1"), (1, "1-a"), (2, "1-b")]


def test_extents_of_a_texts_sections_take_no_shuffle_of_their_own(spark):
    texts = spark.createDataFrame([(1, "Rule 1. A\n(a) x\n(1) y\n(A) z\n(b) w\nRule 2. B\n(a) v"), (2, "none"), (3, None)], "source_id int, text string")
    out = rulebooks.text_extents(rulebooks.read(texts))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted((r.line, r.anchor, r.end_line) for r in out.collect()) == [(0, "1", 5), (1, "1-a", 4), (2, "1-a-1", 4), (3, "1-a-1-A", 4), (4, "1-b", 5), (5, "2", None), (6, "2-a", None)]
    flat = rulebooks.anchors(rulebooks.sections(texts)).select("source_id", "anchor", rulebooks.F.col("line_no").alias("line"))
    assert sorted(map(tuple, rulebooks.extents(flat, "source_id").collect()), key=str) == sorted(map(tuple, out.collect()), key=str)
    assert outline.first_ends(["1", "1-a", "1", "1-a", "2"]) == [{"i": 0, "j": 4}, {"i": 1, "j": 4}, {"i": 4, "j": None}]
