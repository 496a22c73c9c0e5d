"""Bundles of files as tables: written whole or not at all, told by hash, and checked when they are read; rules packs.

A batch of bundles is written to a folder of its own beside its place, parts first and the manifests last, and takes its
place by one rename; a place that is taken is refused, so what stands there never changes. Reading holds every part
against its manifest and every manifest against its bundle's hash; what doesn't fit is a row with its reason.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import once


def manifests(parts: DataFrame, by: str) -> DataFrame:
    """by, manifest, bundle_sha: each bundle's parts (name, content) by name with their hashes and sizes, as JSON, and its
    hash. A name that stands twice in a bundle gives a null manifest: such a bundle can't be written."""
    # Hashes are moved as 32 bytes; as digits they would be twice that, and no shuffle packs them.
    entry = F.struct("name", F.octet_length("content").alias("bytes"), F.unhex(F.sha2(F.col("content"), 256)).alias("sha256"))
    each = parts.groupBy(by).agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    names = F.filter(F.col("_e.name"), lambda n: n.isNotNull())
    told = F.transform("_e", lambda e: F.struct(e["name"].alias("name"), e["bytes"].alias("bytes"), F.lower(F.hex(e["sha256"])).alias("sha256")))
    out = each.select(by, F.when(F.size(F.array_distinct(names)) == F.size(names), F.to_json(F.struct(told.alias("parts")))).alias("manifest"))
    return out.withColumn("bundle_sha", F.sha2("manifest", 256))


def write_bundles(parts: DataFrame, by: str, path: str) -> None:
    """Write the bundles' parts and manifests as a table at path, all or nothing; refused if something stands there, or if a
    name stands twice in a bundle."""
    spark = parts.sparkSession
    place, stage = _path(spark, path), _path(spark, f"{path.rstrip('/')}.{uuid.uuid4().hex}")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(place):
        raise FileExistsError(path)
    try:
        own = manifests(parts, by)
        parts.select(by, "name", "content").write.parquet(f"{stage.toString()}/parts")
        own.write.parquet(f"{stage.toString()}/manifests")
        if not spark.read.schema(own.schema).parquet(f"{stage.toString()}/manifests").where("manifest is null").isEmpty():
            raise ValueError("a name stands twice in a bundle")
        if not fs.rename(stage, place):
            raise FileExistsError(path)
    finally:
        if fs.exists(stage):
            fs.delete(stage, True)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def read_bundles(spark: SparkSession, path: str, by: str) -> tuple[DataFrame, DataFrame]:
    """The parts and manifests of bundles at path, for ``checked``."""
    return spark.read.parquet(f"{path.rstrip('/')}/parts"), spark.read.parquet(f"{path.rstrip('/')}/manifests")


def checked(parts: DataFrame, stored: DataFrame, by: str) -> DataFrame:
    """by, name, reason for everything that doesn't fit: a part that is missing, not in the manifest, or changed, and a manifest
    that isn't its bundle's (name null). Bundles without a row are whole."""
    listed = F.from_json("manifest", "struct<parts:array<struct<name:string,bytes:int,sha256:string>>>")["parts"]
    # Hashes as 32 bytes; whatever else a manifest says is made longer than any hash.
    said = lambda e: F.when(e.rlike("^[0-9a-f]{64}$") & ~e.endswith("\n"), F.unhex(e)).otherwise(F.concat(F.lit(b"\0" * 33), e.cast("binary")))
    kind = "array<struct<name:string,_said:binary,_torn:boolean>>"
    own = F.transform(listed, lambda e: F.struct(e["name"].alias("name"), said(e["sha256"]).alias("_said"), F.lit(False).alias("_torn")))
    torn = F.coalesce(F.sha2("manifest", 256) != F.col("bundle_sha"), F.lit(True))
    mark = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("binary").alias("_said"), F.lit(True).alias("_torn")))
    # Both of a manifest's faults and parts in one pass, so that it is made once.
    rows = stored.select(by, F.inline(F.concat(F.coalesce(own.cast(kind), F.array().cast(kind)), F.when(torn, mark).otherwise(F.array().cast(kind)).cast(kind))))
    sha = F.unhex(F.sha2(F.col("content"), 256))
    have = parts.select(by, "name", sha.alias("_h")).groupBy(by, "name").agg(F.max("_h").alias("_have"), F.min("_h").alias("_least"))
    both = rows.join(have, [by, "name"], "full_outer")
    reason = F.when(F.col("_torn"), "the manifest is not the bundle's").when(F.col("_have").isNull(), "missing").when(F.col("_said").isNull(), "not in the manifest").when((F.col("_have") != F.col("_said")) | (F.col("_least") != F.col("_said")), "changed")
    return both.select(by, "name", reason.alias("reason")).where("reason is not null")


#: What a pack's manifest must hold, by the form of each value. Fixed values.
SHAPES = {"id": r"[a-z0-9][a-z0-9.-]*", "version": r"[A-Za-z0-9][A-Za-z0-9.-]*", "cite_prefix": r".*\S.*", "anchor_prefix": r"[a-z][a-z0-9]*", "rules_md_sha256": r"[0-9a-f]{64}"}
BODY = "<!-- rules -->"
ANCHOR = r'<a id="([^"]+)"></a>'


def pack_bodies(packs: DataFrame, by: str) -> DataFrame:
    """The Markdown body of each pack out of its sections' lines, with an anchor and a label before a line that opens a section,
    and its manifest. packs: by, lines (as ``rulebooks.read`` gives them), id, version, title, cite_prefix, anchor_prefix,
    current_as_of, review_after_days, format. A pack's body is one document, made on the pack's own row."""
    parts = lambda a: F.split(a, "-")
    label = lambda a: F.concat(F.get(parts(a), 0), F.array_join(F.transform(F.slice(parts(a), 2, F.size(parts(a))), lambda x: F.concat(F.lit("("), x, F.lit(")"))), ""))
    mark = lambda a: F.concat(F.lit('<a id="'), F.col("anchor_prefix"), F.lit("-"), a, F.lit('"></a>**['), F.col("cite_prefix"), F.lit(" "), label(a), F.lit("]** "))
    text = F.transform("lines", lambda x: F.concat(F.array_join(F.transform(x["opens"], mark), "\n"), x["line"]))
    out = packs.where(F.size("lines") > 0).withColumn("body", F.concat(F.lit("# "), F.col("title"), F.lit(" ("), F.col("version"), F.lit(f")\n\n{BODY}\n"), F.array_join(text, "\n"), F.lit("\n")))
    names = ["format", "id", "version", "title", "cite_prefix", "anchor_prefix", "current_as_of", "review_after_days"]
    return out.select(by, F.to_json(F.struct(*names, F.sha2("body", 256).alias("rules_md_sha256")), {"ignoreNullFields": "false"}).alias("manifest"), "body")


def _fields() -> Column:
    return F.from_json("manifest", ", ".join(f"{n} string" for n in ("format", *SHAPES, "current_as_of")) + ", review_after_days int")


def _manifest(form: str) -> Column:
    """Why a pack's manifest is refused, its fields (_m) in order; null if it isn't."""
    m = F.col("_m")
    out = F.when(m.isNull() | F.coalesce(F.get_json_object("manifest", "$"), F.lit("")).eqNullSafe(""), "not JSON").when(~m["format"].eqNullSafe(form), f"format is not {form}")
    for name, shape in SHAPES.items():
        out = out.when(~F.coalesce(m[name].rlike(f"^(?:{shape})$"), F.lit(False)), f"{name} is missing or malformed")
    dated = m["current_as_of"].isNull() | (m["current_as_of"].rlike(r"^\d{4}-\d\d-\d\d$") & F.try_to_date(m["current_as_of"]).isNotNull())
    return out.when(~dated, "current_as_of is missing or malformed").when(~F.coalesce(m["review_after_days"] > 0, F.lit(False)), "review_after_days is missing or malformed")


def load_packs(packs: DataFrame, by: str, form: str) -> tuple[DataFrame, DataFrame]:
    """(anchors: by, anchor, line_no, of packs that are sound; refusals: by, reason). packs: by, manifest, body. The first reason
    counts: the manifest's fields, the body's hash, its mark, an anchor that stands twice or lacks the pack's prefix."""
    field = lambda n: F.get_json_object("manifest", f"$.{n}")
    # Each step on the pack's own row; both tables are read off it.
    own = packs.select(by, "body", _fields().alias("_m"), "manifest", field("anchor_prefix").alias("_prefix"), field("rules_md_sha256").alias("_sha"))
    own = own.select(by, "_prefix", _manifest(form).alias("_why"), (F.sha2("body", 256) == F.col("_sha")).alias("_same"), F.split("body", "\n").alias("_l"))
    own = own.withColumn("_start", F.array_position("_l", BODY))
    own = own.withColumn("_why", F.coalesce("_why", F.when(~F.coalesce("_same", F.lit(False)), "the body changed").when(F.col("_start") == 0, "no body mark")))
    after = F.filter(F.transform("_l", lambda t, i: F.when((i + 1 >= F.col("_start")) & F.startswith(t, F.lit('<a id="')), F.struct(F.regexp_extract(t, f"^{ANCHOR}", 1).alias("anchor"), i.cast("long").alias("line_no")))), lambda x: x["anchor"] != "")
    own = own.select(by, "_prefix", "_why", F.when(F.col("_why").isNull(), after).alias("_a"))
    names = F.col("_a.anchor")
    bad = F.when(F.size(F.array_distinct(names)) < F.size(names), "an anchor stands twice").when(F.exists(names, lambda a: ~F.startswith(a, F.concat("_prefix", F.lit("-")))), "an anchor lacks the prefix")
    own = once(own.select(by, "_why", "_a", bad.alias("_bad")), reason=F.coalesce("_why", "_bad"), _found=F.col("_a"))
    return own.where("reason is null").select(by, F.inline("_found")), own.where("reason is not null").select(by, "reason")
