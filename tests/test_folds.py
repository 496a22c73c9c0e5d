"""Folds over sorted rows: any number of rows to a key, stored rows and missing sources in their places."""

from lexmill.functions.folds import folded
from lexmill.operators import machines, transactions


def test_a_fold_keeps_its_state_over_batches_and_no_list_of_a_keys_rows(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(100).selectExpr("id % 3 AS k", "id AS v")

        def step(at, r):
            at["n"] = at.get("n", 0) + r["v"]
            return {"k": r["k"], "v": r["v"], "n": None} if r["v"] % 2 else None

        got = folded(rows, "k", ["v"], dict, step, "k long, v long, n long", end=lambda at, k: {"k": k, "v": None, "n": at["n"]})
        ends = {r.k: r.n for r in got.where("n is not null").collect()}
        assert ends == {k: sum(range(k, 100, 3)) for k in range(3)}
        assert got.where("n is null").count() == 50
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_machines_commands_are_not_gathered(spark):
    c = spark.range(1000).selectExpr("id % 2 AS target_id", "id AS seq", "if(id % 3 = 0, 'fired', 'withdrawn') AS to_state")
    log = machines.run(c, machines.TRIGGER)
    assert "collect_list" not in log._jdf.queryExecution().toString()
    assert [(r.target_id, r.seq) for r in log.where("accepted").orderBy("seq").collect()] == [(0, 0), (1, 1)]


def test_deadlines_take_stored_rows_and_missing_sources(spark):
    names = "target_id long, seq long, op string, label string, due string, state string, verification string, confidence string, owner string, expected string, reason string, by string, sources array<string>, dry_run boolean"
    one = lambda t, s, **x: tuple({"target_id": t, "seq": s, "op": "update", "reason": "r", "by": "b", "dry_run": False, **x}.get(n.split()[0]) for n in names.split(", "))
    c = spark.createDataFrame([one(1, 0, state="met", sources=["gone@1", "a@2"]), one(1, 1, state="met", sources=["a@1"]), one(2, 0, state="met")], names)
    stored = spark.createDataFrame([(1, "L", "2030-01-01", "open", "unverified", "hard", None), (3, "M", "2030-01-01", "open", "unverified", "hard", None)], "target_id long, label string, due string, state string, verification string, confidence string, owner string")
    w = transactions.update_deadlines(stored, c, spark.createDataFrame([("a",)], "rel_path string"))
    assert "collect_list" not in w.log._jdf.queryExecution().toString()
    assert [(r.target_id, r.seq, r.reason) for r in w.log.orderBy("target_id", "seq").collect()] == [(1, 0, "sources not registered: gone"), (1, 1, None), (2, 0, "unknown id")]
    assert [(r.target_id, r.state) for r in w.state.orderBy("target_id").collect()] == [(1, "met"), (3, "open")]
