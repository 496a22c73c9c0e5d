"""Word drafts are dealt to tasks before they are parsed."""

from lexmill.sources import drafts


def test_files_of_one_partition_are_parsed_in_several_tasks(spark):
    files = spark.createDataFrame([(i, b"no archive") for i in range(8)], "k int, content binary").coalesce(1)
    out = drafts.parsed(files, "k")
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "REPARTITION_BY_NUM" in plan[plan.index("ArrowEvalPython") :]
    assert {(r.k, r.read.reason) for r in out.collect()} == {(i, "not a zip archive") for i in range(8)}


def test_a_file_is_parsed_once_after_it_is_dealt_and_read_on_its_own_row(spark):
    from lexmill.plans.drafts import _file

    files = spark.createDataFrame([(i, _file(i)) for i in range(10)], "key int, content binary").coalesce(1)
    read = drafts.parsed(files, "key")
    found = {"paragraphs": drafts.draft_paragraphs(read, "key"), "warnings": drafts.draft_warnings(read, "key"), "texts": drafts.draft_texts(read, "key")}
    for name, df in found.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, name
        assert "REPARTITION_BY_NUM" in plan[plan.index("ArrowEvalPython") :], name
        assert "Join" not in plan and "Window" not in plan, name
    text = {r.key: r.text for r in found["texts"].collect()}
    assert 1 not in text and text[3].startswith("# I. Facts\n\nA. He came 3.\n\n[^n]: I. First note, ECF No. 4.\n\n[^n]: goes on\n\n[^n]: End note.\n\nB. He sat.")
    assert {r.warning for r in found["warnings"].where("key = 1").collect()} == {"refused: tracked changes: insertion"}
