"""What is looked up passes in many tasks; the tables that are built or sorted don't grow with a frequent anchor or a coalesced shuffle."""

from lexmill.operators import diffs, rulebooks


def test_cites_are_neither_broadcast_nor_gathered_at_their_anchor(spark):
    cites = spark.createDataFrame([(i, "12(b)") for i in range(400)], "cite_id int, cite string").coalesce(1)
    anchors = spark.createDataFrame([("fed", "12"), ("fed", "12-b"), ("loc", "12")], "pack string, anchor string")
    out = rulebooks.lookup(cites, anchors, ["pack"])
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan and "_salt" in plan and "REPARTITION_BY_NUM" in plan
    assert {(r.cite_id, r.pack, r.anchor, r.exact) for r in out.collect()} == {(i, *x) for i in range(400) for x in (("fed", "12-b", True), ("loc", "12", False))}


def test_diff_lines_are_dealt_by_diff(spark):
    text = ["+++ b/x", "@@ -1 +3 @@", "+new", "+over"]
    lines = spark.createDataFrame([(d, i, t) for d in range(20) for i, t in enumerate(text)], "d int, line_no int, line string").coalesce(1)
    out = diffs.added_lines(lines, ["d"])
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().sparkPlan().toString()
    assert sorted((r.d, r.path, r.new_line, r.text) for r in out.collect()) == [(d, "x", 3, "new") for d in range(20)]
