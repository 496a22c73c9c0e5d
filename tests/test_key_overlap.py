"""Key overlap without pairs, for key sets of any size."""

from pyspark.sql import functions as F

from lexmill.operators import ledgers


def test_key_overlap_makes_no_pairs(spark):
    """4,000 asks and 4,000 authorities with one key in common: 16 million pairs before."""
    a = spark.range(4_000).select(F.col("id").alias("ask_id"), F.array(F.lit(1), F.col("id") % 3 + 2, F.lit(None)).alias("keys"))
    s = spark.range(4_000).select(F.col("id").alias("auth_id"), F.array(F.lit(1), F.col("id") % 2 + 2, F.lit(1)).alias("keys"))
    got = ledgers.resolve_by_keys(a, s)
    assert got.groupBy("n_found", "ambiguous").count().collect() == [(4_000, True, 4_000)]
    largest = 0
    nodes = [got._jdf.queryExecution().executedPlan()]
    got.collect()
    while nodes:
        n = nodes.pop()
        inner = [n.executedPlan()] if n.nodeName() == "AdaptiveSparkPlan" else [n.plan()] if n.nodeName().endswith("QueryStage") else []
        nodes += inner + [n.children().apply(i) for i in range(n.children().size())]
        if n.metrics().contains("numOutputRows"):
            largest = max(largest, n.metrics().apply("numOutputRows").value())
    assert 0 < largest < 100_000


def test_key_overlap_of_sets_of_any_size(spark):
    import random

    r = random.Random(3)
    some = lambda most: [[r.choice([*range(40), None]) for _ in range(r.randrange(most))] for _ in range(60)]
    asked, stored = some(12), some(9)
    want = {}
    for i, ks in enumerate(asked):
        hits = [j for j, other in enumerate(stored) if {*ks} & {*other} - {None}]
        want[i] = (len(hits), hits[0] if len(hits) == 1 else None, len(hits) > 1)
    df = lambda rows, name: spark.createDataFrame(list(enumerate(rows)), f"{name} int, keys array<int>")
    got = ledgers.resolve_by_keys(df(asked, "ask_id"), df(stored, "auth_id")).collect()
    assert {g.ask_id: (g.n_found, g.auth_id, g.ambiguous) for g in got} == want
