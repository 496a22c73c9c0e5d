"""Commands that write several tables: deadlines with field diffs, triggers that make deadlines, merges of research briefs.

A batch of commands over the stored snapshot gives everything that it would write, as tables that can be written together:
the new state, what was created, the events, and an outcome for every command. A refused command changes nothing. Nothing
is written here, so a dry run is the same call whose outcome alone is read; a command can also ask for a dry run itself.
Ids come from the command's own place, so that a retried batch gives the same ones.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings as S
from ..functions.folds import folded
from ..session import dealt
from . import correspondence, court_days

#: What a deadline's fields may hold.
STATES = ("open", "met", "superseded", "lapsed", "vacated")
VERIFICATIONS = ("verified-official", "secondary-source", "unverified")
CONFIDENCES = ("hard", "working-estimate")
OWNERS = ("ours", "theirs", "court")
ALLOWED = {"state": STATES, "verification": VERIFICATIONS, "confidence": CONFIDENCES, "owner": OWNERS}
FIELDS = ("state", "verification", "confidence", "due", "owner")

_ROW = "struct<label:string,due:string,state:string,verification:string,confidence:string,owner:string>"
_OUTCOME = {"seq": "bigint", "accepted": "boolean", "reason": "string", "changes": "array<struct<field:string,old:string,new:string>>", "event": "string", "by": "string", "sources": "array<string>"}


class Written(NamedTuple):
    """What a batch would write: the state after it, an outcome for each command, and the events of those accepted."""

    state: DataFrame
    log: DataFrame
    events: DataFrame


def _date(text: str | None) -> bool:
    try:
        return text is not None and len(text) == 10 and dt.date.fromisoformat(text).isoformat() == text
    except ValueError:
        return False


def _refused(row: dict | None, c: dict) -> str | None:
    """Why a command is refused over a deadline's row; null if it isn't."""
    if c["op"] == "add":
        if row is not None:
            return "the id is taken"
        if not (c["label"] or "").strip():
            return "label is missing"
        if not _date(c["due"]):
            return "due is not a date"
        return None if c["owner"] is None or c["owner"] in OWNERS else "unknown owner"
    if not (c["reason"] or "").strip():
        return "reason is missing"
    for name, allowed in ALLOWED.items():
        if c[name] is not None and c[name] not in allowed:
            return f"unknown {name}"
    if c["due"] is not None and not _date(c["due"]):
        return "due is not a date"
    if all(c[f] is None for f in FIELDS):
        return "nothing to update"
    if row is None:
        return "unknown id"
    if c["expected"] is not None and c["expected"] != row["state"]:
        return f"expected {c['expected']}, is {row['state']}"
    if all(c[f] is None or c[f] == row[f] for f in FIELDS):
        return "no change"
    return "sources not registered: " + ", ".join(c["missing"]) if c["missing"] else None


def deadline_step(target: object, row: dict | None, c: dict) -> tuple[dict | None, dict]:
    """A command over a deadline's row: the row after it, and its outcome."""
    why, changes, event = _refused(row, c), [], None
    if why is None and c["op"] == "add":
        fresh = {"label": c["label"], "due": c["due"], "state": "open", "verification": c["verification"] or "unverified", "confidence": c["confidence"] or "working-estimate", "owner": c["owner"]}
        event = f"deadline {target} added: {c['label']} due {c['due']} ({fresh['confidence']}/{fresh['verification']})" + (f"; owner: {c['owner']}" if c["owner"] else "")
        row = row if c["dry_run"] else fresh
    elif why is None:
        changes = [{"field": f, "old": row[f], "new": c[f]} for f in FIELDS if c[f] is not None and c[f] != row[f]]
        event = f"deadline {target} {row['label']}: " + "; ".join(f"{x['field']} {'unset' if x['old'] is None else x['old']}→{x['new']}" for x in changes) + f"; reason: {c['reason'].strip()}"
        if not c["dry_run"]:
            row = row | {x["field"]: x["new"] for x in changes}
    done = why is None and not c["dry_run"]
    return row, {"seq": c["seq"], "accepted": why is None, "reason": why, "changes": changes, "event": event if done else None, "by": c["by"], "sources": c["sources"] if done else None}


def _missing(commands: DataFrame, registered: DataFrame) -> DataFrame:
    """target_id, seq, missing: the sources ('path@place') of commands whose path isn't registered."""
    asked = commands.select("target_id", "seq", F.explode("sources").alias("_s")).withColumn("rel_path", S.ref_parts(F.col("_s"))["ref"])
    bad = asked.join(registered.select("rel_path").distinct(), "rel_path", "left_anti")
    return bad.groupBy("target_id", "seq").agg(F.sort_array(F.collect_set("rel_path")).alias("missing"))


def update_deadlines(deadlines: DataFrame, commands: DataFrame, registered: DataFrame) -> Written:
    """deadlines: target_id, label, due, state, verification, confidence, owner. commands: target_id, seq, op (add, update),
    label, due, state, verification, confidence, owner, expected (the state that the caller has seen; null: any), reason,
    by, sources (array), dry_run. registered: rel_path. Each command sees the row that the one before left: stored rows,
    missing sources and commands are sorted together, and one pass keeps a deadline's row."""
    names = ["op", "label", *FIELDS, "expected", "reason", "by", "sources", "dry_run"]
    every = commands.select("target_id", F.lit(2).alias("_kind"), "seq", *names)
    every = every.unionByName(deadlines.select("target_id", F.lit(0).alias("_kind"), "label", *FIELDS), True)
    every = every.unionByName(_missing(commands, registered).select("target_id", F.lit(1).alias("_kind"), "seq", F.col("missing").alias("sources")), True)
    # A stored row comes first, then each command right after what it misses.
    order = [F.col("_kind") > 0, "seq", "_kind", *names]

    def step(at: dict, c: dict) -> dict | None:
        target, kind = c["target_id"], c["_kind"]
        if kind == 0:
            at["row"] = {k: c[k] for k in ("label", *FIELDS)}
            return None
        if kind == 1:
            at["seq"], at["missing"] = c["seq"], c["sources"]
            return None
        c["missing"] = at["missing"] if c["seq"] is not None and at.get("seq") == c["seq"] else []
        at["row"], out = deadline_step(target, at.get("row"), c)
        return {"target_id": target, "row": None, **out}

    def end(at: dict, target: object) -> dict | None:
        row = at.get("row")
        return None if row is None else {**dict.fromkeys(_OUTCOME), "target_id": target, "row": row}

    key = every.schema["target_id"].dataType.simpleString()
    done = folded(every, "target_id", order, dict, step, end=end, schema=f"target_id {key}, " + ", ".join(f"{n} {kind}" for n, kind in _OUTCOME.items()) + f", row {_ROW}")
    log = done.where("row is null")
    events = log.where("event is not null").select("target_id", "seq", F.col("event").alias("text"), "by", "sources")
    return Written(done.where("row is not null").select("target_id", "row.*"), log.select("target_id", "seq", "accepted", "reason", "changes"), events)


class Fired(NamedTuple):
    """What a batch over triggers would write: triggers, new deadlines, events, and an outcome for each command."""

    triggers: DataFrame
    deadlines: DataFrame
    events: DataFrame
    log: DataFrame


def fire_triggers(triggers: DataFrame, commands: DataFrame, registered: DataFrame, calendar: DataFrame, years: DataFrame, today: Column) -> Fired:
    """triggers: target_id, label, waits_on, days, state, rule, owner. commands: target_id, seq, op (fire, withdraw), on (text),
    service, reason, by, sources, dry_run. The first valid command of a waiting trigger takes it; those after it find it
    taken, so no fold is needed. A fired trigger makes a deadline, counted over the calendar. A dry run tells the day and
    takes nothing; it needs no reason and no source, and may lie ahead. Triggers, missing sources and commands are dealt by
    target and sorted once; both windows run over that order."""
    own = ["label", "waits_on", "days", "state", "rule", "owner"]
    every = commands.select("target_id", F.lit(2).alias("_kind"), "seq", "op", "on", "service", "reason", "by", "sources", "dry_run", F.size("sources").alias("_n"), (F.trim(F.coalesce("reason", F.lit(""))) == "").alias("_blank"))
    every = every.unionByName(triggers.select("target_id", F.lit(0).alias("_kind"), *own), True)
    # Only what fires in earnest has its sources looked up.
    asked = commands.where((F.col("op") == "fire") & ~F.coalesce("dry_run", F.lit(False)) & F.col("seq").isNotNull())
    every = every.unionByName(_missing(asked, registered).select("target_id", F.lit(1).alias("_kind"), "seq", F.col("seq").alias("_of"), "missing"), True)
    # A trigger has no seq and comes first, then each command right after what it misses.
    so_far = Window.partitionBy("target_id").orderBy(F.col("seq").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = dealt(every, "target_id").withColumns({n: F.last(n, True).over(so_far) for n in (*own, "_of", "missing")}).where("_kind = 2")
    c = c.withColumn("missing", F.when(F.col("_of") == F.col("seq"), F.col("missing")))
    day = F.when(F.col("on").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("try_cast(on as date)"))
    counted = court_days.count_deadlines(c.withColumn("start", day), calendar, years)
    dry, fire = F.coalesce("dry_run", F.lit(False)), F.col("op") == "fire"
    unfit = (
        F.when(F.col("state").isNull(), "unknown id").when(F.col("state") != "waiting", F.concat(F.lit("already "), F.col("state")))
        .when(fire & F.col("start").isNull(), "not a date").when(fire & (F.col("start") > today) & ~dry, "the day is after today").when(fire & F.col("refused").isNotNull(), F.col("refused"))
        .when(~(fire & dry) & F.col("_blank"), "reason is missing").when(fire & ~dry & (F.col("_n") <= 0), "a source is needed")
        .when(fire & ~dry & (F.size("missing") > 0), F.concat(F.lit("sources not registered: "), F.array_join("missing", ", ")))
    )
    valid = counted.withColumns({"_why": unfit, "_takes": unfit.isNull() & ~dry})
    made = F.concat(F.lit("d_"), F.substring(F.sha2(F.concat_ws("|", F.lit("trigger"), F.col("target_id").cast("string")), 256), 1, 12))
    first = F.first(F.when(F.col("_takes") & F.col("seq").isNotNull(), F.struct("seq", "op", "on")), True).over(so_far)
    out = valid.withColumn("_w", first).withColumn("deadline_id", made)
    late = F.col("_why").isNull() & (F.col("seq") > F.col("_w.seq"))
    out = out.withColumn("reason_refused", F.when(late, F.when(F.col("_w.op") == "fire", F.concat(F.lit("already fired on "), F.col("_w.on"))).otherwise("already withdrawn")).otherwise(F.col("_why")))
    log = out.select("target_id", "seq", F.col("reason_refused").isNull().alias("accepted"), F.col("reason_refused").alias("reason"), F.when(F.col("reason_refused").isNull() & fire, F.col("due")).alias("due"))
    win = out.where("_takes and seq = _w.seq")
    fired = win.where("op = 'fire'")
    deadlines = fired.select(F.col("deadline_id").alias("target_id"), "label", F.col("due").cast("string").alias("due"), F.lit("open").alias("state"), F.lit("unverified").alias("verification"), F.lit("working-estimate").alias("confidence"), "owner")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    tail = F.concat(F.coalesce(F.concat(F.lit("; rule: "), F.col("rule")), F.lit("")), F.coalesce(F.concat(F.lit("; owner: "), F.col("owner")), F.lit("")))
    added = F.concat(text("deadline ", F.col("deadline_id"), " added: ", F.col("label"), " due ", F.col("due"), " (working-estimate/unverified)"), tail, text("; from trigger ", F.col("target_id")))
    done = text("trigger ", F.col("target_id"), " ", F.col("label"), " fired: ", F.col("waits_on"), " on ", F.col("on"), ", service: ", F.col("service"), "; deadline ", F.col("deadline_id"), " due ", F.col("due"), "; reason: ", F.trim("reason"))
    gone = text("trigger ", F.col("target_id"), " ", F.col("label"), ": state waiting→withdrawn; reason: ", F.trim("reason"))
    none = F.array().cast("array<string>")
    told = F.when(fire, F.array(F.struct(F.lit(1).alias("n"), added.alias("text"), none.alias("sources")), F.struct(F.lit(2).alias("n"), done.alias("text"), F.col("sources").alias("sources"))))
    events = win.select("target_id", "seq", "by", F.inline(told.otherwise(F.array(F.struct(F.lit(1).alias("n"), gone.alias("text"), none.alias("sources"))))))
    after = triggers.join(win.select("target_id", F.when(F.col("op") == "fire", "fired").otherwise("withdrawn").alias("_s"), F.when(F.col("op") == "fire", F.col("on")).alias("fired_on"), F.when(F.col("op") == "fire", F.col("deadline_id")).alias("deadline_id")), "target_id", "left")
    return Fired(after.withColumn("state", F.coalesce("_s", "state")).drop("_s"), deadlines, events, log)


#: recipients' statuses that a merge leaves alone, and those whose contact has begun.
CLOSED = ("declined", "opted_out")
CONTACTED = ("shortlisted", "simulated", "consultation", "conflict_check", "follow_up")
DESTINATIONS = ("directory", "portal", "form", "email")
REQUIRED = ("name", "intake_url", "source_url", "intake_channel", "retrieved_at", "destination_type")
KEPT = ("name", "org", "intake_channel", "match_reason", "source_url")


class Merged(NamedTuple):
    """What a merge would write: recipients, evidence (appended), and an outcome for each candidate."""

    recipients: DataFrame
    evidence: DataFrame
    report: DataFrame


def merge_briefs(candidates: DataFrame, stored: DataFrame, suppression: DataFrame, today: Column) -> Merged:
    """candidates: brief_id, seq, name, org, intake_channel, intake_url, source_url, match_reason, retrieved_at, verbatim,
    email, quoted, destination_type. stored: recipient_id, intake_url, status, destination_type, retrieved_at, flags and the
    columns in ``KEPT``. suppression: intake_url, reason.

    A brief with one row that lacks a required field is left out whole. Of the rows with one channel the first by brief and
    seq gives the fields, the others are evidence. A recipient that has declined, or whose channel is suppressed, keeps all
    its fields; one in contact changes its flags, day and an unknown destination only; any other takes the new fields. One
    full outer join of what is stored with the first rows; nothing that was refused for good is revived."""
    missing = F.lit(False)
    for c in REQUIRED:
        missing = missing | (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "")
    bad = candidates.where(missing | ~F.col("destination_type").isin(*DESTINATIONS)).select("brief_id").distinct().withColumn("_bad", F.lit(True))
    mail = F.coalesce(F.col("email"), F.lit("")) != ""
    unsure = ~F.coalesce("verbatim", F.lit(False))
    refused = (
        F.when(F.col("_bad"), "brief aborted").when(F.contains(F.lower("intake_url"), F.lit("mailto:")), "mailto is not a published channel")
        .when(mail, F.coalesce(correspondence.guessed_email(F.col("email"), F.col("quoted")), F.when(unsure, "address is not marked as quoted verbatim")))
    )
    refused = F.coalesce(refused, F.when(F.contains(F.lower("intake_channel"), F.lit("email")) & unsure, "email channel is not marked as quoted verbatim"), F.when(~F.startswith("source_url", F.lit("http")), "no source"))
    key = S.canonical_url(F.col("intake_url"))
    rows = candidates.join(bad, "brief_id", "left").withColumns({"key": key, "_why": refused}).withColumn("_why", F.coalesce("_why", F.when(F.col("key").isNull(), "not an address")))
    rows = rows.withColumn("recipient_id", F.when(F.col("_why").isNull(), S.stable_id(F.col("key"))))
    at = F.struct("brief_id", "seq")
    old = F.to_date(F.try_to_timestamp("retrieved_at"))
    flag = lambda when, name: F.when(when, name)
    own = F.array_compact(F.array(flag(~unsure, "verbatim-unverified"), flag(F.date_diff(today, old) > correspondence.STALE_DAYS, "stale-evidence"), flag(old.isNull(), "unparsed-retrieved-at")))
    good = rows.where("_why is null").withColumn("_flags", own)
    first = good.groupBy("recipient_id").agg(F.min_by(F.struct("key", "retrieved_at", "destination_type", "_flags", *KEPT), at).alias("_c"), F.min(at).alias("_at"), F.count("*").alias("_n"))
    stop = suppression.withColumn("key", S.canonical_url(F.col("intake_url"))).groupBy(S.stable_id(F.col("key")).alias("recipient_id")).agg(F.max("reason").alias("_stop"))
    both = stored.join(first, "recipient_id", "full_outer").join(stop, "recipient_id", "left")
    new, come = F.col("status").isNull(), F.col("_c").isNotNull()
    closed = ~new & (F.col("status").isin(*CLOSED) | F.col("_stop").isNotNull())
    contact = ~new & ~closed & F.col("status").isin(*CONTACTED)
    known = F.nullif(F.nullif(F.coalesce("destination_type", F.lit("")), F.lit("")), F.lit("unknown"))
    clash = ~new & known.isNotNull() & (known != F.col("_c.destination_type"))
    flags = F.array_compact(F.concat(F.col("_c._flags"), F.array(flag(clash, "conflict:destination-mismatch"), flag(F.col("_n") > 1, "duplicate-channel"))))
    takes = come & ~closed
    open_ = takes & ~contact
    none = F.array().cast("array<string>")
    after = both.select(
        "recipient_id", F.coalesce("intake_url", "_c.key").alias("intake_url"), F.when(new, F.coalesce("_stop", F.lit("candidate"))).when(open_, "candidate").otherwise(F.col("status")).alias("status"),
        F.when(takes, F.coalesce(known, F.col("_c.destination_type"))).otherwise(F.col("destination_type")).alias("destination_type"), F.when(takes, F.col("_c.retrieved_at")).otherwise(F.col("retrieved_at")).alias("retrieved_at"),
        F.when(takes, flags).when(come & (F.col("_n") > 1), F.array_union(F.coalesce("flags", none), F.array(F.lit("duplicate-channel")))).otherwise(F.coalesce("flags", none)).alias("flags"),
        *[F.when(open_, F.col(f"_c.{c}")).otherwise(F.col(c)).alias(c) for c in KEPT],
    )
    org = F.nullif(F.lower(F.trim("org")), F.lit(""))
    several = after.groupBy(org.alias("_o")).agg((F.count_distinct("intake_url") > 1).alias("_many")).where("_many and _o is not null")
    after = after.withColumn("_o", org).join(several, "_o", "left").withColumn("flags", F.sort_array(F.when(F.col("_many"), F.array_union("flags", F.array(F.lit("conflict:intake-mismatch")))).otherwise(F.col("flags")))).drop("_o", "_many")
    evidence = good.select("recipient_id", "brief_id", "seq", "source_url", F.col("key").alias("intake_url"), "retrieved_at", F.coalesce("verbatim", F.lit(False)).alias("verbatim"))
    seen = rows.join(first.select("recipient_id", "_at"), "recipient_id", "left").join(stored.select("recipient_id", F.lit(True).alias("_old")).distinct(), "recipient_id", "left")
    outcome = F.when(F.col("_why") == "brief aborted", "aborted").when(F.col("_why").isNotNull(), "rejected").when(F.col("_old").isNull() & (at == F.col("_at")), "imported").otherwise("reused")
    return Merged(after, evidence, seen.select("brief_id", "seq", "recipient_id", outcome.alias("outcome"), F.col("_why").alias("reason")))
