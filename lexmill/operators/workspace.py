"""Workspace: case discovery, source priority, protected paths, sidecars, imports, captures, intake, lists, holidays, grants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def discover(cases: DataFrame, deepest: int = 3) -> DataFrame:
    """cases (rel) with id, depth and the nearest case above: top cases, then subcases inside them, to ``deepest`` parts.
    Parents are found by joining on each path above, so one equi join serves every depth."""
    rel = F.regexp_replace("rel", "/+$", "")
    own = cases.select(rel.alias("rel")).distinct().withColumn("_p", F.split("rel", "/")).withColumn("depth", F.size("_p")).where(F.col("depth") <= deepest)
    own = own.withColumn("case_id", F.substring(F.sha2("rel", 256), 1, 16))
    up = own.where("depth > 1").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("depth") - 1))).select("rel", "_n", F.array_join(F.slice("_p", F.lit(1), F.col("_n")), "/").alias("above"))
    near = up.join(own.select(F.col("rel").alias("above"), F.col("case_id").alias("_id")), "above").groupBy("rel").agg(F.max_by("_id", "_n").alias("parent_id"))
    top = own.where("depth = 1").select("case_id", "rel", "depth", F.lit(None).cast("string").alias("parent_id"))
    return top.unionByName(own.where("depth > 1").join(near, "rel").select("case_id", "rel", "depth", "parent_id"))


def text_source(docs: DataFrame, copies: DataFrame, pages: DataFrame, files: DataFrame, external: DataFrame) -> DataFrame:
    """docs (doc_id, stored_sha, found_sha) with the text to read and where it came from: a named copy, stored pages, a
    text file, text read from the PDF, in this order. A document whose bytes changed has none; of several texts of one
    kind the least counts, so a doc_id that stands twice in a source table gives no more rows."""
    out = docs
    for name, t in (("text copy", copies), ("stored pages", pages), ("text file", files), ("pdf text", external)):
        one = t.groupBy("doc_id").agg(F.min("text").alias("text"))
        out = out.join(one.select("doc_id", F.struct(F.lit(name).alias("label"), F.col("text").alias("text")).alias(f"_{name[:4]}{name[-2:]}")), "doc_id", "left")
    best = F.coalesce(*[F.when(F.col(c)["text"].isNotNull(), F.col(c)) for c in out.columns if c.startswith("_")])
    good = F.col("stored_sha") == F.col("found_sha")
    label = F.when(F.col("found_sha").isNull(), "missing").when(~good, "changed").otherwise(F.coalesce(best["label"], F.lit("none")))
    return out.select("doc_id", label.alias("label"), F.when(good, best["text"]).alias("text"))


def fold_path(path: Column) -> Column:
    """A path as a case-blind file system sees it: lower case, no '.' parts, no doubled or trailing slashes."""
    parts = F.filter(F.split(F.lower(path), "/"), lambda p: (p != "") & (p != "."))
    return F.array_join(parts, "/")


def classify_paths(paths: DataFrame, sources: DataFrame, stores: DataFrame) -> DataFrame:
    """paths (path) with why they are protected: a registered source, a folder above one, or a member of a store folder;
    null for others. Ancestors are explode of the sources' parts, so each test is an equi join."""
    p = paths.withColumn("_f", fold_path(F.col("path")))
    s = sources.select(fold_path(F.col("path")).alias("_f")).distinct()
    parts = F.split("_f", "/")
    above = s.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("_f")).distinct()
    inside = p.select("_f", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("_s"))
    member = inside.join(stores.select(fold_path(F.col("path")).alias("_s")).distinct(), "_s").select("_f").distinct()
    flag = lambda t, n: t.withColumn(n, F.lit(True))
    out = p.join(flag(s, "_a"), "_f", "left").join(flag(above.join(s, "_f", "left_anti"), "_b"), "_f", "left").join(flag(member, "_c"), "_f", "left")
    return out.select("path", F.when(F.col("_a"), "source").when(F.col("_c"), "store").when(F.col("_b"), "above a source").alias("protected"))


def docket_map(sidecars: DataFrame) -> DataFrame:
    """case_id, entry, rel_path of JSON sidecars {"entries": {"16": "a.pdf"}}; a sidecar of another shape gives one row
    without entry, so that it can be refused."""
    got = F.from_json("json", "struct<entries:map<string,string>>")["entries"]
    return sidecars.select("case_id", F.explode_outer(got).alias("entry", "rel_path"))


def import_briefs(items: DataFrame, required: list[str], by: str = "brief_id") -> DataFrame:
    """All rows of the briefs whose every row has every required field; a brief with one bad row gives none."""
    blank = F.lit(False)
    for c in required:
        blank = blank | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    bad = items.where(blank).select(by).distinct()
    return items.join(bad, by, "left_anti")


def result_hits(results: DataFrame, text: str, by: list[str]) -> DataFrame:
    """by, n, uuid, title: hits of a result text, written '[title](id:uuid)' or 'uuid: title' on a line; the first place of
    each uuid counts."""
    uuid = r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"
    link, plain = rf"\[([^\]\n]*)\]\(id:({uuid})\)", rf"(?m)^({uuid}): ([^\n]*)$"
    every = results.select(*by, F.posexplode(F.regexp_extract_all(text, F.lit(f"{link}|{plain}"), F.lit(0))).alias("n", "_h"))
    out = every.select(*by, "n", F.regexp_extract("_h", f"({uuid})", 1).alias("uuid"), F.when(F.startswith("_h", F.lit("[")), F.regexp_extract("_h", link, 1)).otherwise(F.regexp_extract("_h", plain, 2)).alias("title"))
    return out.groupBy(*by, "uuid").agg(F.min("n").alias("n"), F.min_by("title", "n").alias("title"))


def captures(pages: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new documents: sha256, url of their first retrieval; provenance: a row for every retrieval). pages: url, at, body."""
    seen = pages.withColumn("sha256", F.sha2(F.col("body"), 256))
    new = seen.join(stored.select("sha256"), "sha256", "left_anti").groupBy("sha256").agg(F.min_by("url", F.struct("at", "url")).alias("url"))
    return new, seen.select("url", "at", "sha256")


def read_text(files: DataFrame, content: str = "content") -> DataFrame:
    """Bytes as text: UTF-8 without its mark, bad bytes replaced."""
    text = F.make_valid_utf8(F.col(content).cast("string"))
    return files.withColumn("text", F.regexp_replace(text, "^﻿", ""))


def report(rows: DataFrame, by: str, title: str, order: list[str], cells: list[str]) -> DataFrame:
    """A Markdown table and a JSON manifest of each group's rows, in order: one document a group."""
    cell = lambda x: F.replace(F.replace(x.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(cell(F.col(c)), F.lit("")) for c in cells]), F.lit(" |"))
    one = F.sort_array(F.collect_list(F.struct(*order, line.alias("_line"), F.struct(*cells).alias("_row"))))
    head = f"# {title}\n\n| {' | '.join(cells)} |\n|{'---|' * len(cells)}\n"
    out = rows.groupBy(by).agg(one.alias("_a"))
    return out.select(by, F.concat(F.lit(head), F.array_join(F.transform("_a", lambda x: x["_line"]), "\n"), F.lit("\n")).alias("markdown"), F.to_json(F.transform("_a", lambda x: x["_row"]), {"ignoreNullFields": "false"}).alias("manifest"))


def register_holidays(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (day, name, seq) with whether each is added: its day isn't stored and no earlier request has it."""
    first = F.row_number().over(Window.partitionBy("day").orderBy("seq")) == 1
    known = stored.select("day").distinct().withColumn("_k", F.lit(True))
    return asked.withColumn("_f", first).join(known, "day", "left").select("day", "name", "seq", (F.col("_f") & F.col("_k").isNull()).alias("added"))


def active_grants(log: DataFrame) -> DataFrame:
    """The grant of each case and provider after its log (case_id, provider, action, seq, by_person): the newest action
    counts; a proposal stays one until a person activates it; declining or revoking leaves no right."""
    counted = log.where(F.col("by_person") | (F.col("action") == "propose"))
    last = counted.groupBy("case_id", "provider").agg(F.max_by("action", "seq").alias("action"), F.max(F.when(F.col("action") != "propose", F.struct("seq", "action"))).alias("_d"))
    state = F.when(F.col("action") == "propose", F.when(F.col("_d.action") == "activate", "active").otherwise("proposed")).when(F.col("action") == "activate", "active").when(F.col("action") == "decline", "declined").otherwise("revoked")
    return last.select("case_id", "provider", state.alias("state"))


def intake_steps(cases: DataFrame, counts: DataFrame) -> DataFrame:
    """Checklist of each case: step, number, done. counts: case_id and one column a step."""
    steps = [c for c in counts.columns if c != "case_id"]
    out = cases.select("case_id").join(counts, "case_id", "left").na.fill(0)
    rows = F.array(*[F.struct(F.lit(i).alias("number"), F.lit(s).alias("step"), (F.col(s) > 0).alias("done")) for i, s in enumerate(steps, 1)])
    return out.select("case_id", F.inline(rows))


def child_lines(children: DataFrame, deadlines: DataFrame) -> DataFrame:
    """A status line for each subcase (parent_id, case_id, title): its open deadlines and the next of them."""
    d = deadlines.where("state = 'open'").groupBy("case_id").agg(F.count("*").alias("_n"), F.min("due").alias("_d"))
    out = children.join(d, "case_id", "left")
    text = F.when(F.coalesce("_n", F.lit(0)) == 0, "no open deadlines").otherwise(F.concat(F.col("_n").cast("string"), F.when(F.col("_n") == 1, " open deadline, due ").otherwise(" open deadlines, next "), F.col("_d").cast("string")))
    return out.select("parent_id", "case_id", F.concat(F.col("title"), F.lit(": "), text).alias("line"))


def count_steps(counted: DataFrame) -> DataFrame:
    """counted (trigger_id, start, days, landed, due, and closed: an array of struct(day, reason) passed over) with the steps
    of the count in words, a reason for each day rolled over."""
    landed = F.col("landed").cast("string")
    steps = F.array(
        F.concat(F.lit("start "), F.col("start").cast("string"), F.lit(", not counted")), F.concat(F.lit("count "), F.col("days").cast("string"), F.when(F.col("days") == 1, " day").otherwise(" days"), F.lit(": "), landed),
    )
    passed = F.transform("closed", lambda c: F.concat(c["day"].cast("string"), F.lit(" is closed ("), c["reason"], F.lit(")")))
    due = F.when(F.col("due") != F.col("landed"), F.array(F.concat(F.lit("due "), F.col("due").cast("string")))).otherwise(F.array().cast("array<string>"))
    return counted.select("trigger_id", F.array_join(F.concat(steps, passed, due), "; ").alias("steps"))


def explained(triggers: DataFrame, calendar: DataFrame) -> DataFrame:
    """triggers (trigger_id, start, days) counted over a calendar (day, next_open, reason): landed, due, and closed, the days
    from the landed one to the due one with their reasons. A calendar has some hundred days a year."""
    runs = calendar.where("day <> next_open").groupBy("next_open").agg(F.array_sort(F.collect_list(F.struct("day", "reason"))).alias("_run"))
    by_day = calendar.select(F.col("day").alias("landed"), "next_open").join(runs, "next_open", "left")
    none = F.array().cast("array<struct<day:date,reason:string>>")
    by_day = by_day.select("landed", F.col("next_open").alias("due"), F.filter(F.coalesce("_run", none), lambda c: c["day"] >= F.col("landed")).alias("closed"))
    return triggers.withColumn("landed", F.expr("date_add(start, days)")).join(F.broadcast(by_day), "landed", "left").select("trigger_id", "start", "days", "landed", "due", "closed")


def document_list(documents: DataFrame, captures_: DataFrame) -> DataFrame:
    """Every document with how often it was captured and the newest place, for lists."""
    c = captures_.groupBy("sha256").agg(F.count("*").alias("n_captures"), F.max_by("url", F.struct("at", "url")).alias("last_url"))
    return documents.join(c, "sha256", "left").withColumn("n_captures", F.coalesce("n_captures", F.lit(0)))
