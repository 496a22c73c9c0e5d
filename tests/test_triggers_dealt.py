"""Commands over triggers are dealt once: no join moves them by target again."""

from pyspark.sql import functions as F

from lexmill.operators import court_days, transactions


def fired(spark):
    t = spark.createDataFrame([(1, "Answer", "service", 5, "waiting", None, "ours"), (2, "Reply", "order", 5, "waiting", "R 1", None)], "target_id int, label string, waits_on string, days int, state string, rule string, owner string")
    rows = [
        (1, 4, "fire", "2026-03-02", "none", "r", ["a@1"], False), (1, 1, "fire", "2026-03-02", "none", "r", ["c@1", "b@2", "a@3"], False), (1, 2, "fire", "2026-03-03", "mail", None, [], True), (1, 3, "fire", "2026-03-03", "none", "r", [], False),
        (1, 5, "withdraw", None, None, "r", ["z@1"], False), (1, None, "withdraw", None, None, "r", ["z@1"], False), (2, 9, "withdraw", None, None, "moot ", None, None), (2, 10, "fire", "2026-03-02", "none", "r", ["z"], False), (3, 1, "withdraw", None, None, "r", [], False),
    ]
    c = spark.createDataFrame([(*r, "kim") for r in rows], "target_id int, seq int, op string, on string, service string, reason string, sources array<string>, dry_run boolean, by string")
    years = spark.createDataFrame([(2026,)], "year int")
    return transactions.fire_triggers(t, c, spark.createDataFrame([("a",), ("a",)], "rel_path string"), court_days.calendar(spark, 2026, 2026), years, F.to_date(F.lit("2026-03-05")))


def test_outcomes_deadlines_and_events(spark):
    f = fired(spark)
    got = {(r.target_id, r.seq): (r.reason, r.due and str(r.due)) for r in f.log.collect()}
    assert got == {
        (1, None): (None, None), (1, 1): ("sources not registered: b, c", None), (1, 2): (None, "2026-03-12"), (1, 3): ("a source is needed", None), (1, 4): (None, "2026-03-09"), (1, 5): ("already fired on 2026-03-02", None),
        (2, 9): (None, None), (2, 10): ("sources not registered: z", None), (3, 1): ("unknown id", None),
    }
    assert [(r.label, r.due, r.owner) for r in f.deadlines.collect()] == [("Answer", "2026-03-09", "ours")]
    assert sorted((r.target_id, r.seq, r.n, r.by) for r in f.events.collect()) == [(1, 4, 1, "kim"), (1, 4, 2, "kim"), (2, 9, 1, "kim")]
    assert {r.target_id: (r.state, r.fired_on) for r in f.triggers.collect()} == {1: ("fired", "2026-03-02"), 2: ("withdrawn", None)}


def test_commands_are_dealt_by_target_once(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        f = fired(spark)
        for out in (f.log, f.deadlines, f.events):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin [target_id" not in plan
            assert plan.count("Exchange hashpartitioning(target_id#") == 2  # the commands, and what they miss
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
