"""Notices, drafts, contacts and requests: filters, order columns, guards, canonical forms and greedy batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names under which several statuses are asked for.
STATUS_ALIASES = {"open": ["proposed", "approved"], "all": None}
#: Phrases that a letter to a stranger must not hold. The sender's own names and addresses come before
#: them and are the caller's (``own``).
UNSAFE_PHRASES = [
    "start your business", "form your llc", "see attached", "attached please find", "exhibit a", "affidavit excerpt", "i have strong evidence that", "the defendant did the following",
]
STALE_DAYS = 90


def status_filter(df: DataFrame, status: str, wanted: str, aliases: dict[str, list[str] | None] | None = None) -> DataFrame:
    """Rows whose status is the one wanted, or one that the alias stands for; an alias of None keeps all."""
    aliases = STATUS_ALIASES if aliases is None else aliases
    names = aliases.get(wanted, [wanted])
    return df if names is None else df.where(F.col(status).isin(*names))


def attribution(author: Column, directed_by: Column) -> Column:
    """'author' or 'author, directed by x'; null if a part is blank or holds the words or the comma of the form itself.
    Agents are always directed by someone."""
    bad = lambda c: c.isNull() | (F.trim(c) == "") | F.contains(c, F.lit(",")) | F.contains(c, F.lit("directed by"))
    whole = F.when(directed_by.isNull(), author).otherwise(F.concat(author, F.lit(", directed by "), directed_by))
    alone = directed_by.isNull() & author.startswith("agent:")
    return F.when(~bad(author) & (directed_by.isNull() | ~bad(directed_by)) & ~alone, whole)


def canonical_json(df: DataFrame, cols: list[str]) -> Column:
    """The columns as JSON with sorted keys, no blanks, nulls written out."""
    return F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"})


def record_hash(df: DataFrame, cols: list[str], out: str = "sha256") -> DataFrame:
    return df.withColumn(out, F.sha2(canonical_json(df, cols), 256))


def search_key(provider: Column, jurisdiction: Column, query: Column) -> Column:
    """One key for queries that differ in blanks and case only."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    return F.sha2(F.to_json(F.array(fold(provider), fold(jurisdiction), fold(query))), 256)


def calendar_escape(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\r\n", "\\n"), ("\n", "\\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _fold(line: str) -> str:
    """Lines of at most 75 octets, cut between characters; each further line begins with a blank."""
    out, size = [], 0
    for ch in line:
        n = len(ch.encode())
        if size + n > 75:
            out.append("\r\n ")
            size = 1
        out.append(ch)
        size += n
    return "".join(out)


def calendar_fold(c: Column) -> Column:
    """Content lines folded by octets: counting bytes by character has no native form."""

    @F.pandas_udf("string")
    def fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else _fold(t))

    return F.when(F.octet_length(c) <= 75, c).otherwise(fold(c))


def to_line(name: Column, org: Column) -> Column:
    """'name, org', or the name alone where it holds the organisation already."""
    return F.when(org.isNull() | (F.trim(org) == "") | F.contains(F.lower(name), F.lower(org)), name).otherwise(F.concat(name, F.lit(", "), org))


def guessed_email(email: Column, quoted: Column) -> Column:
    """Why an address is refused: it doesn't stand in what was quoted from the source. Null where it may be used."""
    there = F.contains(F.lower(F.coalesce(quoted, F.lit(""))), F.lower(email))
    return F.when(email.isNotNull() & (F.trim(email) != "") & ~there, "address is not quoted from the source")


def unsafe_reason(subject: Column, body: Column, phrases: list[str] | None = None, own: list[str] | None = None) -> Column:
    """The first phrase, by place in the lists, that a draft must not hold, or 'exhibit' for a numbered exhibit."""
    text = F.lower(F.concat_ws("\n", subject, body))
    every = [*(own or []), *(UNSAFE_PHRASES if phrases is None else phrases)]
    return F.coalesce(*[F.when(F.contains(text, F.lit(p.lower())), p) for p in every], F.when(text.rlike(r"\bexhibit\s+[0-9]+\b"), "exhibit"))


def stale(retrieved_at: Column, today: Column, most: int = STALE_DAYS) -> Column:
    """Older than ``most`` days; text without a zone is UTC (the session's zone), unreadable or missing text is stale."""
    return F.coalesce(F.date_diff(today, F.to_date(F.try_to_timestamp(retrieved_at))) > most, F.lit(True))


def by_status(ranks: list[str], status: Column) -> list[Column]:
    """Order columns: statuses in the order given, unknown ones last."""
    at = F.array_position(F.array(*[F.lit(r) for r in ranks]), status)
    return [F.when(at > 0, at).otherwise(len(ranks) + 1).asc()]


def numbered(df: DataFrame, order: list[Column], by: list[str] | None = None, out: str = "place") -> DataFrame:
    """Place of each row in an order, from 1."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)))


def notice_ledger(notices: DataFrame, parties: DataFrame, selections: DataFrame, assertions: DataFrame) -> DataFrame:
    """notices (notice_id, party_id) with the party's name and the texts of their selected assertions in order.
    selections: notice_id, position, assertion_id. ``missing`` counts selected assertions that don't exist."""
    chosen = selections.join(assertions.select("assertion_id", "text"), "assertion_id", "left").groupBy("notice_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "assertion_id", "text"))).alias("_s"), F.count_if(F.col("text").isNull()).alias("missing")
    )
    return notices.join(parties, "party_id", "left").join(chosen, "notice_id", "left").select(
        *notices.columns, "party_name", F.coalesce(F.transform("_s", lambda s: F.coalesce(s["text"], F.lit("?"))), F.array().cast("array<string>")).alias("texts"), F.coalesce("missing", F.lit(0)).alias("missing")
    )


def request_batches(cites: DataFrame, by: str, order: str, text: str, most: int = 60, most_chars: int = 64_000) -> DataFrame:
    """Number of the request that each cite goes in: greedy in order, at most ``most`` cites and ``most_chars``
    characters with their line ends. One draft's cites are one group; a longer cite than the bound is alone."""
    source = cites.select(by, order, text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        batch, n, size, out = 0, 0, 0, []
        for line in t.column(text).to_pylist():
            k = len(line or "")
            if n and (n == most or size + 1 + k > most_chars):
                batch, n, size = batch + 1, 0, 0
            size += k + (1 if n else 0)
            n += 1
            out.append(batch)
        return t.append_column("batch", pa.array(out, pa.int64()))

    return source.groupBy(by).applyInArrow(fill, f"{fields}, batch long")


def valid_request(payload: Column, line: str = r"^[0-9]{1,4} [A-Z][A-Za-z0-9. ]* [0-9]{1,6}\z", most: int = 60, most_chars: int = 64_000) -> Column:
    """Whether a request holds only lines of the cite grammar, none repeated, within both bounds."""
    lines = F.split(payload, "\n")
    return F.coalesce((F.length(payload) <= most_chars) & (F.size(lines) <= most) & F.forall(lines, lambda x: x.rlike(line)) & (F.size(F.array_distinct(lines)) == F.size(lines)), F.lit(False))


def modes(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, ties to the least; null values don't count."""
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col(value))).alias("_m")).select(*by, F.col(f"_m.{value}").alias(value), "_m.n")


def saved_counts(saved: DataFrame) -> DataFrame:
    """Distinct searches and cites of each case in the saved answers (case_id, kind, key)."""
    of = lambda k: F.count_distinct(F.when(F.col("kind") == k, F.col("key")))
    return saved.groupBy("case_id").agg(of("search").alias("searches"), of("cite").alias("cites"))


def case_overview(cases: DataFrame, documents: DataFrame, facts: DataFrame, sources: DataFrame, deadlines: DataFrame, authorities: DataFrame, waiting: DataFrame, today: Column) -> DataFrame:
    """Every case with its counts: documents, facts, unsupported facts, open and overdue deadlines, letters that wait for
    an answer, unverified authorities. Each table is counted by case before it is joined."""
    backed = facts.join(sources.select("fact_id").distinct().withColumn("_b", F.lit(True)), "fact_id", "left")
    is_open = F.col("state") == "open"
    parts = [
        documents.groupBy("case_id").agg(F.count("*").alias("documents")),
        backed.groupBy("case_id").agg(F.count("*").alias("facts"), F.count_if(F.col("_b").isNull()).alias("unsupported")),
        deadlines.groupBy("case_id").agg(F.count_if(is_open).alias("open"), F.count_if(is_open & (F.col("due") < today)).alias("overdue")),
        waiting.groupBy("case_id").agg(F.count("*").alias("waiting")),
        authorities.groupBy("case_id").agg(F.count_if(F.col("status") == "unverified").alias("unverified")),
    ]
    out = cases.select("case_id").distinct()
    for p in parts:
        out = out.join(p, "case_id", "left")
    return out.na.fill(0)
