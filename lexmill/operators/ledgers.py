"""Facts, links, notices, drafts and authorities: joins, roll-ups, orders and sets over many cases at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: An authority's stages, best first.
AUTHORITY_RANK = ["source-checked", "resolved", "unverified", "stale-flagged"]


def facts_with_sources(facts: DataFrame, sources: DataFrame, documents: DataFrame) -> DataFrame:
    """facts (fact_id) with an array of their sources' documents, in document order; empty where there is none."""
    linked = sources.join(documents, "doc_id").groupBy("fact_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", "rel_path", "locator"))).alias("sources"))
    return facts.join(linked, "fact_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast(linked.schema["sources"].dataType)))


def unsupported(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts without any source."""
    return facts.join(sources.select("fact_id"), "fact_id", "left_anti")


def latest_drafts(drafts: DataFrame, recipients: DataFrame, key: str, created: str) -> DataFrame:
    """Each recipient's newest drafts; drafts of the same newest moment all stay."""
    newest = F.rank().over(Window.partitionBy(key).orderBy(F.desc(created))) == 1
    return drafts.withColumn("_new", newest).where("_new").drop("_new").join(recipients, key)


#: Key sets up to this size are counted by their subsets, 63 at most.
SUBSETS = 6


def _key_sets(df: DataFrame, by: str) -> DataFrame:
    """by and the sorted set of all its keys."""
    known = F.filter("keys", lambda k: k.isNotNull())
    return df.groupBy(by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(known)))).alias("_ks"))


def _subsets(sets: DataFrame, by: str) -> DataFrame:
    """by, _t, _sign: every non-empty subset of a small key set, and 1 or -1 as its size is odd or even."""
    masks = sets.where(F.size("_ks") > 0).withColumn("_m", F.explode(F.expr("sequence(1, shiftleft(1, size(_ks)) - 1)")))
    return masks.select(by, F.expr("filter(_ks, (x, i) -> getbit(_m, i) = 1)").alias("_t"), F.when(F.bit_count("_m") % 2 == 1, 1).otherwise(-1).alias("_sign"))


def resolve_by_keys(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """asked (ask_id, keys) against stored (auth_id, keys) that share a key: n_found and, if exactly one, auth_id;
    over one is refused as ambiguous.

    A key that many rows have would give a pair for each two of them, so pairs are counted, not made: those that share a
    key are the sum over the subsets of the asked keys of how many stored sets hold that subset, of odd size less of even
    size. Sets of over ``SUBSETS`` keys are paired, each different one once."""
    a, s = _key_sets(asked, "ask_id"), _key_sets(stored, "auth_id")
    small = F.size("_ks") <= SUBSETS
    held = _subsets(s.where(small), "auth_id").groupBy("_t").agg(F.count("*").alias("_n"), F.min("auth_id").alias("_a"))
    counted = _subsets(a.where(small), "ask_id").join(held, "_t").select("ask_id", (F.col("_sign") * F.col("_n")).alias("_n"), F.col("_a"))

    def paired(x: DataFrame, y: DataFrame) -> DataFrame:
        x = x.where(F.size("_ks") > 0)
        mine = x.select("_ks").distinct().select("_ks", F.explode("_ks").alias("_k"))
        pairs = mine.join(y.select("auth_id", F.explode("_ks").alias("_k")), "_k").select("_ks", "auth_id").distinct()
        n = pairs.groupBy("_ks").agg(F.count("*").alias("_n"), F.min("auth_id").alias("_a"))
        return x.join(n, "_ks").select("ask_id", "_n", "_a")

    every = counted.unionByName(paired(a.where(~small), s)).unionByName(paired(a.where(small), s.where(~small)))
    hit = every.groupBy("ask_id").agg(F.sum("_n").alias("n_found"), F.min("_a").alias("auth_id"))
    return asked.select("ask_id").join(hit, "ask_id", "left").select(
        "ask_id", F.coalesce("n_found", F.lit(0)).alias("n_found"), F.when(F.col("n_found") == 1, F.col("auth_id")).alias("auth_id"), (F.coalesce("n_found", F.lit(0)) > 1).alias("ambiguous")
    )


def best_status(authorities: DataFrame, key: str, status: str, order: str) -> DataFrame:
    """One authority of each key: the best stage, then the first entered; and whether the key has several."""
    rank = F.coalesce(*[F.when(F.col(status) == s, F.lit(i)) for i, s in enumerate(AUTHORITY_RANK)], F.lit(len(AUTHORITY_RANK)))
    w = Window.partitionBy(key)
    return authorities.withColumns({"_r": F.row_number().over(w.orderBy(rank, order)), "duplicated": F.count("*").over(w) > 1}).where("_r = 1").drop("_r")


def docket_resolve(cites: DataFrame, docket: DataFrame, names: DataFrame, files: DataFrame) -> DataFrame:
    """cites (case_id, entry_key) to a path: the docket map's, else the one a file name suggests; with the verdict
    of the registered file's hash against the one found."""
    d = docket.select("case_id", "entry_key", F.col("rel_path").alias("mapped"))
    n = names.groupBy("case_id", "entry_key").agg(F.min("rel_path").alias("suggested"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    f = files.select("case_id", "rel_path", "stored_sha", "found_sha")
    out = cites.join(d, ["case_id", "entry_key"], "left").join(n, ["case_id", "entry_key"], "left").withColumn("rel_path", F.coalesce("mapped", "suggested"))
    out = out.join(f, ["case_id", "rel_path"], "left")
    verdict = (
        F.when(F.col("rel_path").isNull() | F.col("stored_sha").isNull(), "record-not-in-store")
        .when(F.col("found_sha").isNull(), "source-missing").when(F.col("found_sha") != F.col("stored_sha"), "source-changed")
        .when(F.col("mapped").isNull(), "record-unconfirmed").otherwise("ok")
    )
    return out.withColumn("verdict", verdict)


def gaps(numbers: DataFrame, by: str, n: str) -> DataFrame:
    """Missing numbers from 1 to each group's largest, as ranges: by, lo, hi. Gaps stand between neighbours, so no
    list of all numbers is made."""
    seen = numbers.select(by, F.col(n).cast("long").alias("n")).distinct()
    before = F.coalesce(F.lag("n").over(Window.partitionBy(by).orderBy("n")), F.lit(0).cast("long"))
    return seen.where("n > 0").withColumn("_b", before).where("n > _b + 1").select(by, (F.col("_b") + 1).alias("lo"), (F.col("n") - 1).alias("hi"))


def first_seen(cites: DataFrame, by: list[str], key: str, order: str, extra: list[str]) -> DataFrame:
    """Distinct cites of each group in order of first appearance: n, first place, how often, and sorted sets of extras."""
    out = cites.groupBy(*by, key).agg(F.min(order).alias("first_at"), F.count("*").alias("times"), *[F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in extra])
    return out.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("first_at", key)))


def first_wins(rows: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The first row of each key and how many it stands for."""
    keys = [key] if isinstance(key, str) else key
    names = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_f"), F.count("*").alias("n_rows")).select(*keys, "_f.*", "n_rows")


def suppressed(candidates: DataFrame, suppression: DataFrame, key: str) -> DataFrame:
    """Candidates with the reason of a standing refusal, which always wins; null if there is none."""
    s = suppression.groupBy(key).agg(F.max("reason").alias("suppressed_for"))
    return candidates.join(s, key, "left")


def conflicts(rows: DataFrame, group: Column, value: str, name: str = "conflict") -> DataFrame:
    """Rows with a flag: their group (folded) has more than one value."""
    g = F.lower(F.trim(group))
    many = rows.groupBy(g.alias("_g")).agg((F.count_distinct(value) > 1).alias(name))
    return rows.withColumn("_g", g).join(many, "_g", "left").drop("_g")


def count_statuses(rows: DataFrame, status: str, all_of: list[str]) -> DataFrame:
    """Counts of every status asked for, zero where none stands."""
    dim = rows.sparkSession.createDataFrame([(s,) for s in all_of], f"{status} string")
    return F.broadcast(dim).join(rows.groupBy(status).agg(F.count("*").alias("n")), status, "left").select(status, F.coalesce("n", F.lit(0)).alias("n"))


def not_in_count(rows: DataFrame, status: str, good: list[str]) -> DataFrame:
    """Rows whose status is not among the good ones; a null status counts on neither side, as in SQL."""
    return rows.agg(F.count_if(~F.col(status).isin(*good)).alias("n"))


def case_panel(deadlines: DataFrame, by: str, today: Column) -> DataFrame:
    """Roll-up of each case's deadlines: n, open, overdue, next due and its label."""
    is_open = F.col("state") == "open"
    late = is_open & (F.col("due") < today)
    ahead = is_open & (F.col("due") >= today)
    return deadlines.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(is_open).alias("n_open"), F.count_if(late).alias("n_overdue"),
        F.min(F.when(ahead, F.col("due"))).alias("next_due"), F.min_by("label", F.when(ahead, F.struct("due", "label"))).alias("next_label"),
    )


def passed_first(today: Column) -> list[Column]:
    """Order of a deadline list: passed ones first, undated last, then by date and label."""
    return [(~F.coalesce(F.col("due") < today, F.lit(False))).asc(), F.col("due").isNull().asc(), F.col("due").asc(), F.col("label").asc()]


def docket_order(key: Column) -> list[Column]:
    """'23-1' after '23' and before '100'."""
    parts = F.split(key, "-")
    return [F.try_to_number(F.element_at(parts, 1), F.lit("999999999")).cast("long"), F.coalesce(F.try_element_at(parts, F.lit(2)).cast("long"), F.lit(0).cast("long"))]


def ordered_text(rows: DataFrame, by: list[str], text: str, order: list[str], sep: str = "; ") -> DataFrame:
    """The group's texts on end, in order."""
    one = F.sort_array(F.collect_list(F.struct(*order, text)))
    return rows.groupBy(*by).agg(F.array_join(F.transform(one, lambda x: x[text]), sep).alias("joined"))


def batches(cites: DataFrame, by: str, order: str, most: int = 60) -> DataFrame:
    """Number of the request that each cite goes in, at most ``most`` a request, in order."""
    return cites.withColumn("batch", ((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / most).cast("long"))


def budget_use(log: DataFrame, provider: str, ts: str, event: str) -> DataFrame:
    """Requests of each provider and UTC day; notes don't count."""
    return log.where(F.coalesce(F.col(event) != "note", F.lit(True))).groupBy(provider, F.to_date(ts).alias("day")).agg(F.count("*").alias("used"))


def newest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest record of each key."""
    rest = [c for c in log.columns if c not in key]
    return log.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_n")).select(*key, "_n.*")


#: Words in a ledger's status cell and the status of each, weakest first.
LEDGER_STATUS = [("UNVERIFIED", "unverified"), ("PARTIAL", "research-pending"), ("V-WORKER", "resolved"), ("V-LEAD", "source-checked")]
#: Headings of a ledger's columns.
LEDGER_COLUMNS = {"citation": "authority|case|citation", "ledger_status": "status", "source": "source", "proposition": "proposition|used for|language|holding", "notes": "note|treatment|adverse|limit"}


def authority_rows(rows: DataFrame) -> DataFrame:
    """Rows of an authority ledger under their names (citation, ledger_status, source, ...): status is the weakest that the
    cell names, unverified without a source, null where it names none; pins are confirmed for a bare V-LEAD, or where the
    cell says so. Rows without a citation go."""
    dash = lambda c: F.nullif(F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("—")), F.lit("-"))
    own = rows.withColumns({"citation": F.nullif(dash(F.col("citation")), F.lit("")), "source": F.nullif(dash(F.col("source")), F.lit(""))}).where("citation is not null")
    cell = F.upper(F.coalesce("ledger_status", F.lit("")))
    named = F.coalesce(*[F.when(F.contains(cell, F.lit(w)), s) for w, s in LEDGER_STATUS])
    status = F.when(named.isNotNull(), F.when(F.col("source").isNull(), "unverified").otherwise(named))
    confirmed = (status == "source-checked") & (F.contains(cell, F.lit("PINS CONFIRMED")) | (F.trim(cell) == "V-LEAD"))
    return own.withColumn("status", status).withColumn("pins_unconfirmed", F.coalesce((status == "source-checked") & ~confirmed, F.lit(False)))
