"""Cases and their subcases: grants out of a log, sources in a parent case, status lines, JSON sidecars, lists of deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import strings as S
from . import correspondence, extraction


def grant_records(log: DataFrame) -> DataFrame:
    """What stands for each case and provider after its log (case_id, provider, seq, op): proposals, and whether a person's
    grant, the case's default or a person's refusal does.

    'activate' takes the place of all; 'decline' too, and stands until an activation; 'revoke' drops all but a refusal;
    'propose' adds a proposal, which gives no right; 'default' counts only while no one has decided. Only the last of each
    matters, so this is one grouping, not a fold."""
    last = lambda *ops: F.max(F.when(F.col("op").isin(*ops), F.col("seq")))
    g = log.groupBy("case_id", "provider").agg(last("activate").alias("a"), last("decline").alias("d"), last("revoke").alias("r"), F.collect_list(F.when(F.col("op") == "propose", F.col("seq"))).alias("p"), last("default").alias("f"))
    no = F.lit(-1)
    a, d, r = (F.coalesce(c, no) for c in "adr")
    refused, cut = d > a, F.greatest(a, d, r)
    given = (a > d) & (a > r)
    default = F.coalesce(F.col("f") > cut, F.lit(False)) & ~given & ~refused
    return g.select("case_id", "provider", F.size(F.filter("p", lambda s: s > cut)).alias("proposals"), given.alias("granted"), default.alias("by_default"), refused.alias("declined"))


PARENT = "parent:"


def attach_sources(asked: DataFrame, documents: DataFrame, parents: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links: case_id, fact_id, rel_path, locator, refused; new: case_id, rel_path, sha256). asked: case_id, fact_id, ref
    ('path@place', or 'parent:path@place' for a document of the parent case). documents: case_id, rel_path, sha256. parents:
    case_id, parent_id. found: case_id, rel_path, sha256 of the files as they are now.

    A parent's document is cited only as it was registered: its file is there and unchanged. It is entered in the subcase once,
    as a reference without bytes, unless the same bytes are there already under another path."""
    parts = S.ref_parts(F.col("ref"))
    a = asked.withColumns({"_p": parts["ref"], "locator": parts["locator"]}).withColumn("_up", F.startswith("_p", F.lit(PARENT)))
    a = a.withColumn("_path", F.when(F.col("_up"), F.substring("_p", len(PARENT) + 1, 10_000)).otherwise(F.col("_p"))).join(parents, "case_id", "left")
    a = a.withColumn("_in", F.when(F.col("_up"), F.col("parent_id")).otherwise(F.col("case_id")))
    have = documents.select(F.col("case_id").alias("_in"), F.col("rel_path").alias("_path"), F.col("sha256").alias("_sha"))
    now = found.select(F.col("case_id").alias("_in"), F.col("rel_path").alias("_path"), F.col("sha256").alias("_now"))
    own = documents.select("case_id", F.col("rel_path").alias("_local"), F.col("sha256").alias("_own"))
    a = a.join(have, ["_in", "_path"], "left").join(now, ["_in", "_path"], "left").withColumn("_local", F.concat(F.lit(PARENT), "_path")).join(own, ["case_id", "_local"], "left")
    same = documents.groupBy("case_id", F.col("sha256").alias("_sha")).agg(F.min("rel_path").alias("_same"))
    a = a.join(same, ["case_id", "_sha"], "left")
    refused = (
        F.when(F.col("_up") & F.col("parent_id").isNull(), "not a subcase").when(F.col("_sha").isNull(), "not registered").when(F.col("_up") & F.col("_now").isNull(), "missing").when(F.col("_up") & (F.col("_now") != F.col("_sha")), "changed")
        .when(F.col("_up") & F.col("_own").isNotNull() & (F.col("_own") != F.col("_sha")), "registered here with other bytes")
    )
    path = F.when(refused.isNull(), F.when(~F.col("_up"), F.col("_path")).when(F.col("_own").isNotNull(), F.col("_local")).otherwise(F.coalesce("_same", "_local")))
    out = a.withColumns({"refused": refused, "rel_path": path})
    new = out.where(F.col("refused").isNull() & F.col("_up") & F.col("_own").isNull() & F.col("_same").isNull()).groupBy("case_id", "rel_path").agg(F.max("_sha").alias("sha256"))
    return out.select("case_id", "fact_id", "rel_path", "locator", "refused"), new


def child_status(children: DataFrame, deadlines: DataFrame, today: Column) -> DataFrame:
    """parent_id, case_id, line: each subcase (parent_id, case_id, name, title) with its open and overdue deadlines."""
    late = D.overdue(F.col("due"), F.col("state"), today)
    n = deadlines.where("state = 'open'").groupBy("case_id").agg(F.count("*").alias("_n"), F.count_if(late).alias("_l"))
    out = children.join(n, "case_id", "left").na.fill(0, ["_n", "_l"])
    line = F.concat(F.lit("- "), "name", F.lit(" — "), F.coalesce("title", "name"), F.lit(" · Open deadlines: "), F.col("_n").cast("string"), F.lit(" · "), F.when(F.col("_l") > 0, "⚠ ").otherwise(""), F.lit("OVERDUE: "), F.col("_l").cast("string"))
    return out.select("parent_id", "case_id", line.alias("line"))


#: The shapes of JSON sidecars: the list that each holds and its items, or the fields of a single object.
SIDECARS = {
    "docket": ("entries", "map<string,string>"), "consent": ("grants", "array<struct<provider:string,kind:string,status:string,daily_budget:int>>"),
    "attachments": ("packs", "array<struct<id:string,version:string,prefix:string>>"), "manifest": ("parent", "string"),
}


def sidecars(files: DataFrame, kind: str) -> DataFrame:
    """files (case_id, json) of one kind, a row for each item: of a docket entry and path, of consent and attachments their
    items' fields, of a manifest parent and title. One that is missing, torn or of another shape gives one row with
    ``refused``, and no item: it is never trusted in part."""
    name, shape = SIDECARS[kind]
    whole = F.from_json("json", f"struct<{name}:{shape}{',title:string' if kind == 'manifest' else ''}>", {"mode": "PERMISSIVE"})
    raw = F.get_json_object("json", f"$.{name}")
    read = files.withColumn("_w", whole).withColumn("_v", F.col("_w")[name])
    held = {"docket": F.startswith(raw, F.lit("{")), "manifest": F.trim(F.coalesce("_v", F.lit(""))) != ""}.get(kind, F.startswith(raw, F.lit("[")))
    read = read.withColumn("refused", F.when(~F.coalesce(held & F.col("_v").isNotNull(), F.lit(False)), f"no {name} in it"))
    if kind == "manifest":
        return read.select("case_id", F.when(F.col("refused").isNull(), F.col("_v")).alias("parent"), F.when(F.col("refused").isNull(), F.col("_w.title")).alias("title"), "refused")
    good = read.withColumn("_v", F.when(F.col("refused").isNull(), F.col("_v")))
    if kind == "docket":
        return good.select("case_id", "refused", F.explode_outer("_v").alias("entry", "rel_path")).where("refused is not null or entry is not null")
    return good.select("case_id", "refused", F.inline_outer("_v"))


def select_deadlines(deadlines: DataFrame, closed: bool = False, owner: str | None = None) -> DataFrame:
    """Deadlines to list: open ones unless ``closed``, of one owner if given; sort by due."""
    out = deadlines if closed else deadlines.where("state = 'open'")
    return out if owner is None else out.where(F.col("owner") == owner)


def due_within(deadlines: DataFrame, today: Column, days: int) -> DataFrame:
    """Open deadlines of the next ``days`` days, today's included, with the days left."""
    return select_deadlines(deadlines).withColumn("days_left", F.date_diff("due", today)).where(F.col("days_left").between(0, days))


def deadline_line(today: Column, show_state: bool = False) -> Column:
    """A line of the list: day, label, how sure, rule, owner, state; what is overdue last."""
    sure = F.when(F.col("verification") != "verified-official", F.concat(F.lit(" ("), "confidence", F.lit("/"), "verification", F.lit(")"))).otherwise("")
    own = F.when(F.coalesce(F.col("owner"), F.lit("")) != "", F.concat(F.lit("  owner="), "owner")).otherwise("")
    state = F.concat(F.lit("  state="), "state") if show_state else F.lit("")
    late = F.when(D.overdue(F.col("due"), F.col("state"), today), "  ⚠ OVERDUE").otherwise("")
    return F.concat(F.col("due").cast("string"), F.lit("  "), "label", sure, F.lit("  ["), F.coalesce("rule", F.lit("—")), F.lit("]"), own, state, late)


def register_years(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (year, jurisdiction, seq) for lists of holidays that are complete: which are recorded, and why the others aren't."""
    first = asked.groupBy("year").agg(F.min(F.when(F.trim(F.coalesce("jurisdiction", F.lit(""))) != "", F.col("seq"))).alias("_first"))
    known = stored.select("year").distinct().withColumn("_known", F.lit(True))
    out = asked.join(first, "year", "left").join(known, "year", "left")
    refused = (
        F.when(~F.coalesce(F.col("year").between(1900, 2200), F.lit(False)), "not a year").when(F.trim(F.coalesce("jurisdiction", F.lit(""))) == "", "jurisdiction is missing")
        .when(F.col("_known") | (F.col("seq") != F.col("_first")), "recorded already")
    )
    return out.select("year", "seq", refused.alias("refused"))


def statute_payload(asked: DataFrame, text: str, by: list[str], most: int = 120) -> DataFrame:
    """by, sent: what a lookup of a statute cite may send. The text must be one cite with a section sign from end to end; a
    closing bracket that isn't a subdivision (a year, a publisher) goes, and what is left must be one too. Else null."""
    mark = r"\((?:[0-9]{1,3}[A-Za-z]?|[A-Za-z]{1,2}|[ivxIVX]{1,5})\)"
    t = F.trim(text)
    fit = (F.length(t) <= most) & ~t.rlike(r"\p{Cntrl}") & F.contains(t, F.lit("§"))
    bare = F.regexp_replace(t, rf"(?:\s*(?!{mark})\([^()]*\))+$", "")
    own = asked.select(*by, F.when(fit, bare).alias("_sent"), F.when(fit, t).alias("_whole"))
    spans = extraction.extract(own, "_sent", by).where("start = 0 and status = 'extracted'").groupBy(*by).agg(F.max("end").alias("_end"))
    other = F.regexp_replace("_sent", mark, "").rlike("[()]")
    return asked.select(*by).join(own, by, "left").join(spans, by, "left").select(*by, F.when((F.col("_end") == F.length("_sent")) & ~other, F.col("_sent")).alias("sent"))


def spaced_json(cols: list[str]) -> Column:
    """The columns as JSON with sorted keys, a blank after each comma and colon, nulls written out."""
    value = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.expr(f"substring(to_json(named_struct('v', `{c}`)), 6, length(to_json(named_struct('v', `{c}`))) - 6)"))
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{c}": '), value(c)) for c in sorted(cols)]), F.lit("}"))


def in_sets(universe: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """part, n: how many keys of the universe both sets have, one alone, or neither; zeros too."""
    tag = lambda t, n: t.select(key).distinct().withColumn(n, F.lit(True))
    both = universe.select(key).distinct().join(tag(first, "_a"), key, "full").join(tag(second, "_b"), key, "full")
    part = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "first").when(F.col("_b"), "second").otherwise("neither")
    n = both.select(part.alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    every = universe.sparkSession.createDataFrame([(x,) for x in ("both", "first", "second", "neither")], "part string")
    return F.broadcast(every).join(n, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n"))


def first_of_each(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return correspondence.numbered(rows, order, by, "_place").where(F.col("_place") <= most).drop("_place")
