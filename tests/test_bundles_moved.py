"""Bundles are checked with one shuffle of their parts for the manifests and one of each side of the check."""

from lexmill.sources import bundles


def test_a_check_shuffles_each_side_once(spark):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = spark.createDataFrame([(1, "a", b"x"), (1, "b", b"y"), (2, "a", b"z")], "bundle int, name string, content binary")
        out = bundles.checked(parts, bundles.manifests(parts, "bundle"), "bundle")
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
        assert out.count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_what_does_not_fit(spark):
    parts = spark.createDataFrame([(1, "a", b"x"), (1, "b", b"y"), (2, "a", b"z"), (3, "a", b"z"), (4, "a", b"z"), (4, "a", b"y"), (5, "a", None), (6, None, b"z")], "bundle int, name string, content binary")
    made = {r.bundle: (r.manifest, r.bundle_sha) for r in bundles.manifests(parts, "bundle").collect()}
    x = "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    y = "a1fce4363854ff888cff4b8e7875d600c2682390412a8cf79b37d0b11148b0fa"
    assert made[1][0] == f'{{"parts":[{{"name":"a","bytes":1,"sha256":"{x}"}},{{"name":"b","bytes":1,"sha256":"{y}"}}]}}'
    assert made[4] == (None, None) and made[5][0] == '{"parts":[{"name":"a"}]}'
    upper, torn = made[1][0].replace(x, x.upper()), made[2][0]
    stored = spark.createDataFrame([(1, upper, made[1][1]), (2, torn, "0"), (3, torn.replace('"a"', '"c"'), None), (4, *made[4])], "bundle int, manifest string, bundle_sha string")
    got = sorted((r.bundle, r.name or "", r.reason) for r in bundles.checked(parts, stored, "bundle").collect())
    whole = "the manifest is not the bundle's"
    assert got == [
        (1, "", whole), (1, "a", "changed"), (2, "", whole), (3, "", whole), (3, "a", "not in the manifest"), (3, "c", "missing"),
        (4, "", whole), (4, "a", "not in the manifest"), (5, "a", "missing"), (6, "", "not in the manifest"),
    ]
