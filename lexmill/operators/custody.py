"""Registering and re-verifying files by hash: classify, dedupe, verify."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a folder's name says of its files, first hint wins.
DIR_KINDS = [
    ("filings", "filing"), ("filing", "filing"), ("evidence", "evidence"), ("correspondence", "correspondence"),
    ("records_requests", "correspondence"), ("case_tracking", "tracker"), ("research", "research"),
    ("source_orders", "media"), ("media", "media"), ("admin", "admin"),
]
#: What a file name's extension says.
EXT_KINDS = {
    "filing": "pdf docx doc", "research": "md txt", "media": "jpg jpeg png mp3 m4a wav mov mp4", "evidence": "csv xlsx", "correspondence": "eml",
}


def classify(path: Column) -> Column:
    """Kind by the first folder hint in the path, else by extension, else 'other'."""
    parts = F.split(F.lower(path), "/")
    ext = F.regexp_extract(F.element_at(parts, -1), r"[^.]\.([^.]*)$", 1)
    out = F.when(F.lit(False), "")
    for hint, kind in DIR_KINDS:
        out = out.when(F.array_contains(parts, hint), kind)
    for kind, exts in EXT_KINDS.items():
        out = out.when(ext.isin(*exts.split()), kind)
    return out.otherwise("other")


def register(files: DataFrame, known: DataFrame | None = None, excluded: Column | None = None) -> DataFrame:
    """files (rel_path, sha256) with outcome: 'excluded', 'skipped' (bytes or path known already, or met before in
    this batch) or 'added', and kind. Of rows with one path or one hash the first by path and hash counts, so a path that
    comes with other bytes too is added once."""
    out = files.withColumn("kind", classify(F.col("rel_path")))
    out = out.withColumn("_out", F.lit(False) if excluded is None else excluded)
    # The smallest hash of a path, and among those rows the smallest path of a hash: counted, not sorted, as one hash may
    # have a third of all rows; the join is by path and hash together.
    one = out.groupBy("_out", "rel_path").agg(F.min("sha256").alias("sha256")).groupBy("_out", "sha256").agg(F.min("rel_path").alias("rel_path"))
    out = out.join(one.withColumn("_win", F.lit(True)), ["_out", "rel_path", "sha256"], "left")
    first = F.col("_win").isNotNull() & (F.row_number().over(Window.partitionBy("_out", "rel_path", "sha256").orderBy(F.lit(1))) == 1)
    old = F.lit(False)
    if known is not None:
        by_sha = known.select(F.col("sha256").alias("k_sha")).distinct()
        by_path = known.select(F.col("rel_path").alias("k_path")).distinct()
        out = out.join(by_sha, out.sha256 == by_sha.k_sha, "left").join(by_path, out.rel_path == by_path.k_path, "left")
        old = F.col("k_sha").isNotNull() | F.col("k_path").isNotNull()
    return out.withColumn("outcome", F.when(F.col("_out"), "excluded").when(old | ~first, "skipped").otherwise("added")).select(*files.columns, "kind", "outcome")


def verify(stored: DataFrame, found: DataFrame) -> DataFrame:
    """stored and found (rel_path, sha256): verdict ESCAPED, MISSING, CHANGED or ok of each stored row."""
    now = found.select(F.col("rel_path").alias("now_path"), F.col("sha256").alias("now_sha"))
    out = stored.join(now, stored.rel_path == now.now_path, "left")
    escaped = F.col("rel_path").startswith("/") | F.array_contains(F.split("rel_path", "/"), "..")
    return out.withColumn("verdict", F.when(escaped, "ESCAPED").when(F.col("now_path").isNull(), "MISSING").when(F.col("sha256") != F.col("now_sha"), "CHANGED").otherwise("ok")).drop("now_path", "now_sha")


def recorded_name(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """asked (rel_path, sha256) with the path that the record knows it by: the same path, else the first document
    with the same bytes."""
    same = stored.select(F.col("rel_path").alias("same_path")).distinct()
    by_sha = stored.groupBy(F.col("sha256").alias("s")).agg(F.min("rel_path").alias("first_path"))
    out = asked.join(same, asked.rel_path == same.same_path, "left").join(by_sha, asked.sha256 == by_sha.s, "left")
    return out.withColumn("recorded", F.coalesce("same_path", "first_path")).drop("same_path", "s", "first_path")


def parent_agreement(child: DataFrame, parent: DataFrame, scan: DataFrame) -> DataFrame:
    """child, parent and scan (rel_path, sha256): do all three hashes agree."""
    p = parent.select("rel_path", F.col("sha256").alias("parent_sha"))
    s = scan.select("rel_path", F.col("sha256").alias("scan_sha"))
    out = child.join(p, "rel_path", "left").join(s, "rel_path", "left")
    ok = (F.col("sha256") == F.col("parent_sha")) & (F.col("parent_sha") == F.col("scan_sha"))
    return out.withColumn("agrees", F.coalesce(ok, F.lit(False)))
