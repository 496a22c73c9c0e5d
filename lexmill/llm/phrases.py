"""Operator 11: collocations by level-wise passes over frequent phrases.

Level 1 counts words for each language. What is frequent gets a number, and each block of texts is written once as the
numbers of its words (-1: not frequent, or a piece's end). Level k sees, at each place, the number of the frequent
(k-1)-gram that starts there; a k-gram is counted only where this place and the next both have one, and is told
exactly by the two numbers, not by a hash. Counts leave a task pre-aggregated and are added up by Spark; what reaches
the threshold is the level's table, with the numbers of its left and right (k-1)-gram.

A level's table is broadcast to number the places of the next level while it stays under ``BROADCAST_BYTES``, packed by
tasks and unpacked by workers: the driver passes bytes on, and lets them go when the level is written. Joins of level
tables are merge joins by name, as Spark would broadcast a table by its size on disk, which packs many times over. Beyond,
each block asks for its own different k-grams by a join and gets their numbers back, so nothing grows with the corpus
but shuffled rows. Both ways give the same numbers.

Cuts are scored from the level tables: following left numbers gives a phrase's first words, right numbers its last, so
l and r come along by joins. Where a longer phrase has the same count, so has one a single word longer, so a phrase
is dropped if one of the next level holds it as often. Products are decimals of 38 digits, exact up to 10^16 words of a
language; the first 2000 are taken by parts of a language, then by language.

Null texts count as empty, a null lang as `und`. Very long texts are taken in parts of whole pieces; only a piece over
``BLOCK_BYTES`` makes a larger block. Of cuts with equal scores the shortest first part counts; phrases of equal score
and count are ranked by UTF-8 bytes. Repeated rows count each time; doc_id and other columns take no part, whatever
they are called. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U, drop, mix, narrow, pack_arrays, stage_at, unpack_arrays, widen

LEAST = 100
LONGEST = 5
FIRST = 2000
BLOCK_BYTES = 1 << 20
BROADCAST_BYTES = 48 << 20
#: Different words or pairs that a task holds before it sends their counts on.
HELD = 600_000
#: Words of the corpus for each bucket of pairs.
PER_BUCKET = 2_000_000
#: Parts of a language that are ranked by themselves first.
PARTS = 64
SALTS = 16
#: A byte that UTF-8 never has: it stands for a piece's end.
END = b"\xff"
FLAT = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d", END * 10)


def tokens(texts: list[bytes]) -> list[bytes]:
    """Words of flattened texts in order; END stands where a piece or a text ends."""
    return (b" " + END + b" ").join(texts).replace(END, b" " + END + b" ").split()


def flattened(text: bytes) -> Iterator[bytes]:
    """The text in lower case with END for each character that ends a piece, in parts of whole pieces of about ``BLOCK_BYTES``."""
    flat = text.lower().translate(FLAT)
    at = 0
    while len(flat) - at > BLOCK_BYTES:
        cut = flat.rfind(END, at + 1, at + BLOCK_BYTES)
        cut = cut if cut > 0 else flat.find(END, at + BLOCK_BYTES)
        if cut < 0:
            break
        yield flat[at:cut]
        at = cut
    yield flat[at:]


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Flattened texts of one language, about ``BLOCK_BYTES`` at a time; of many languages the fullest goes first."""
    held: dict[str, list[bytes]] = {}
    size: Counter[str] = Counter()
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            for part in flattened(text.as_py() or b""):
                held.setdefault(lang, []).append(part)
                size[lang] += len(part)
                full = lang if size[lang] >= BLOCK_BYTES else max(size, key=lambda x: (size[x], x)) if sum(size.values()) > 4 * BLOCK_BYTES else None
                if full is not None:
                    yield full, held.pop(full)
                    del size[full]
    yield from held.items()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[bytes]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                c.pop(END, None)
                words = list(c)
                for i in range(0, len(words), 100_000):
                    part = words[i : i + 100_000]
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang] * len(part), pa.string()), "word": pa.array(part, pa.binary()).cast(pa.string()), "n": pa.array([c[w] for w in part], pa.int64()),
                    })
            counts.clear()

        for lang, texts in by_language(batches):
            counts.setdefault(lang, Counter()).update(tokens(texts))
            if sum(map(len, counts.values())) >= HELD // 2:
                yield from out()
        yield from out()

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _blob(ids: np.ndarray, block: int) -> pa.RecordBatch:
    """A block's places: numbers from 0 for none, in as few bytes as the largest needs, compressed. Readers take thousands
    of rows at a time, so a row must stay small."""
    top = int(ids.max(initial=-1)) + 1
    width = next(w for w in (1, 2, 3, 4, 5, 6, 7, 8) if top < 1 << (8 * w))
    blob = pack_arrays([np.array([width], np.int64), narrow((ids + 1).astype(U), width)])
    return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "ids": pa.array([blob], pa.binary())})


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for b in batches:
        for block, blob in zip(b.column("block"), b.column("ids"), strict=True):
            width, ids = unpack_arrays(blob.as_py())
            yield block.as_py(), widen(ids, int(width[0])).astype(np.int64) - 1


def _block_ids() -> Iterator[int]:
    from pyspark import TaskContext

    part, k = TaskContext.get().partitionId(), 0
    while True:
        yield (part << 32) | k
        k += 1


PLACES = "block long, ids binary"


def packed(level: DataFrame, *columns: str) -> Broadcast[list[bytes]]:
    """Columns of a small table as a broadcast of compressed Arrow streams, made by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_pydict({"blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    blobs = level.select(*columns).mapInArrow(run, "blob binary").collect()
    return level.sparkSession.sparkContext.broadcast([bytes(r["blob"]) for r in blobs])


def unpacked(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    for blob in blobs:
        yield from pa.ipc.open_stream(blob)


#: The words of one broadcast by language, kept from task to task in a Python worker.
_KNOWN: dict[int, dict[str, dict[bytes, int]]] = {}


def _known_words(number: int, blobs: list[bytes]) -> dict[str, dict[bytes, int]]:
    if number not in _KNOWN:
        _KNOWN.clear()
        found: dict[str, dict[bytes, int]] = {}
        for r in unpacked(blobs):
            for lang, word, i in zip(*(r.column(j).to_pylist() for j in range(3)), strict=True):
                found.setdefault(lang, {})[word.encode()] = i
        _KNOWN[number] = found
    return _KNOWN[number]


def number_words(docs: DataFrame, words: DataFrame, known: Broadcast[list[bytes]] | None) -> DataFrame:
    """Blocks of texts as numbers of frequent words, one for each place. known: the words' lang, phrase and id, if they are few."""
    if known is not None:
        number = uuid.uuid4().int

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _known_words(number, known.value)
            for (lang, texts), block in zip(by_language(batches), _block_ids(), strict=False):
                own = found.get(lang, {})
                if own:
                    yield _blob(np.array([own.get(w, -1) for w in tokens(texts)], np.int64), block)

        return docs.mapInArrow(run, PLACES)

    # Too many words to broadcast: each block sends its different words, and where they stand, through a join.
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, texts), block in zip(by_language(batches), _block_ids(), strict=False):
            places: dict[bytes, list[int]] = {}
            every = tokens(texts)
            for i, w in enumerate(every):
                if w != END:
                    places.setdefault(w, []).append(i)
            keys = list(places)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block] * len(part), pa.int64()), "size": pa.array([len(every)] * len(part), pa.int64()), "lang": pa.array([lang] * len(part), pa.string()),
                    "phrase": pa.array(part, pa.binary()).cast(pa.string()), "places": pa.array([np.array(places[w], "<i4").tobytes() for w in part], pa.binary()),
                })

    def put(key: tuple, t: pa.Table) -> pa.Table:
        ids = np.full(t.column("size")[0].as_py(), -1, np.int64)
        for places, i in zip(t.column("places").to_pylist(), t.column("id").to_pylist(), strict=True):
            ids[np.frombuffer(places, "<i4")] = i
        return pa.Table.from_batches([_blob(ids, key[0].as_py())])

    asked = docs.mapInArrow(ask, "block long, size long, lang string, phrase string, places binary")
    return salted_join(asked, words.select("lang", "phrase", "id"), ["lang", "phrase"]).groupBy("block").applyInArrow(put, PLACES)


def salted_join(asked: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """A common word is asked for by every block: its rows are dealt over ``SALTS`` keys, what is known stands under each."""
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
    return asked.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")).join(known.withColumn("salt", salts).hint("merge"), [*on, "salt"])


def _pairs(ids: np.ndarray) -> np.ndarray:
    """Where a place and the next both have a number."""
    return np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0)) if len(ids) > 1 else np.zeros(0, np.int64)


def _distinct(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs, the first's place in sorted order of all, how often each stands there, and that order."""
    order = np.lexsort((right, left))
    a, b = left[order], right[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[new], b[new], np.diff(np.append(new, len(a))), order


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and their counts from several such lists, each pair once, sorted."""
    left, right, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    a, b, many, order = _distinct(left, right)
    return a, b, np.add.reduceat(n[order], np.cumsum(many) - many) if len(a) else n


def pair_counts(places: DataFrame, least: int, buckets: int) -> DataFrame:
    """left, right, n: the next level's grams that reach the threshold, from places where both their parts are frequent.
    A task sends its different pairs with their counts, packed, to buckets by hash, each pair from a task once or twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            left, right, n = _merged(held)
            held.clear()
            bucket = (mix(left.astype(U), right.astype(U)) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            heads = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            blobs = [pack_arrays([x[part] for x in (left, right, n)]) for part in np.split(order, heads[1:])]
            return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[order][heads], pa.int32()), "blob": pa.array(blobs[: len(heads)], pa.binary())})

        for _, ids in _blocks(batches):
            at = _pairs(ids)
            a, b, n, _ = _distinct(ids[at], ids[at + 1])
            held.append((a, b, n.astype(np.int64)))
            size += len(a)
            if size >= HELD:  # most pairs come again: only what stays different counts
                held[:] = [_merged(held)]
                size = len(held[0][0])
                if size >= HELD // 2:
                    yield out()
                    size = 0
        if size:
            yield out()

    def add(key: tuple, t: pa.Table) -> pa.Table:
        left, right, n = _merged([tuple(unpack_arrays(blob)) for blob in t.column("blob").to_pylist()])
        on = n >= least
        return pa.table({"left": pa.array(left[on]), "right": pa.array(right[on]), "n": pa.array(n[on])})

    return places.mapInArrow(run, "bucket int, blob binary").groupBy("bucket").applyInArrow(add, "left long, right long, n long")


def number_pairs(places: DataFrame, level: DataFrame, known: Broadcast[list[bytes]] | None) -> DataFrame:
    """The same blocks with, at each place, the number of the level's gram that starts there. known: the level's left, right
    and id, if they are few."""
    if known is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = list(unpacked(known.value))
            a, b, number = (np.concatenate([p.column(i).to_numpy() for p in parts] or [np.zeros(0, np.int64)]) for i in range(3))
            del parts
            order = np.lexsort((b, a))
            a, b, number = a[order], b[order], number[order]
            lefts, rights = np.unique(a), np.unique(b)
            # The pair as one number, by the places of its parts among all: sorted as the pairs are.
            keys = np.searchsorted(lefts, a) * len(rights) + np.searchsorted(rights, b)
            for block, ids in _blocks(batches):
                out = np.full(len(ids), -1, np.int64)
                at = _pairs(ids)
                if len(at) and len(keys):
                    x, y = (np.minimum(np.searchsorted(part, ids[p]), len(part) - 1) for part, p in ((lefts, at), (rights, at + 1)))
                    ask = x * len(rights) + y
                    place = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
                    hit = (keys[place] == ask) & (lefts[x] == ids[at]) & (rights[y] == ids[at + 1])
                    out[at[hit]] = number[place[hit]]
                if (out >= 0).any():
                    yield _blob(out, block)

        return places.mapInArrow(run, PLACES)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids in _blocks(batches):
            at = _pairs(ids)
            a, b, n, order = _distinct(ids[at], ids[at + 1])
            spots = np.split(at[order], np.cumsum(n)[:-1])
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([block] * len(a), pa.int64()), "size": pa.array([len(ids)] * len(a), pa.int64()), "left": pa.array(a), "right": pa.array(b),
                "places": pa.array([s.astype("<i4").tobytes() for s in spots[: len(a)]], pa.binary()),
            })

    def put(key: tuple, t: pa.Table) -> pa.Table:
        ids = np.full(t.column("size")[0].as_py(), -1, np.int64)
        for spots, i in zip(t.column("places").to_pylist(), t.column("id").to_pylist(), strict=True):
            ids[np.frombuffer(spots, "<i4")] = i
        return pa.Table.from_batches([_blob(ids, key[0].as_py())])

    asked = places.mapInArrow(ask, "block long, size long, left long, right long, places binary")
    return salted_join(asked, level.select("left", "right", "id"), ["left", "right"]).groupBy("block").applyInArrow(put, PLACES)


def levels(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame, list[str]]:
    """The level tables (lang, phrase, last, id, left, right, n, first1.., rest1..: counts of its first and last words),
    the words of each language, and the folders written."""
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    paths: list[str] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        got, path = stage_at(df, f"phrases-{name}")
        paths.append(path)
        return got

    every = put(word_counts(own), "words")
    words = every.groupBy("lang").agg(F.sum("n").alias("words"))
    # Numbers are given out once and written: a retried task can't give others.
    level = put(every.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.monotonically_increasing_id().alias("id"), "n"), "1")
    out = [level]
    buckets = max(1, (every.agg(F.sum("n").alias("n")).first()["n"] or 0) // PER_BUCKET)
    places, last = None, ""
    for k in range(2, longest + 1):
        # A word takes its bytes and about 150 more in a dictionary, a pair some 50 bytes while it is sorted.
        weight = F.sum(F.octet_length("phrase") + 150) if k == 2 else F.count("id") * 50
        small = (level.agg(weight.alias("size")).first()["size"] or 0) <= BROADCAST_BYTES
        known = packed(level, *(("lang", "phrase") if k == 2 else ("left", "right")), "id") if small else None
        numbered = number_words(own, level, known) if k == 2 else number_pairs(places, level, known)
        places, path = stage_at(numbered, f"phrases-places-{k - 1}")
        if known is not None:
            known.unpersist(blocking=True)
        drop(spark, [last] if last else [])
        last = path
        found = put(pair_counts(places, least, buckets).withColumn("id", F.monotonically_increasing_id()), f"pairs-{k}")
        before = [f"first{j}" for j in range(1, k - 1)], [f"rest{j}" for j in range(1, k - 1)]
        a = level.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), *before[0], F.col("n").alias(f"first{k - 1}"))
        b = level.select(F.col("id").alias("right"), "last", *before[1], F.col("n").alias(f"rest{k - 1}"))
        joined = found.join(a.hint("merge"), "left").join(b.hint("merge"), "right")
        level = put(joined.withColumn("phrase", F.concat_ws(" ", "head", "last")).drop("head"), str(k))
        out.append(level)
    drop(spark, [last])
    return out, words, paths


def cut_score(left: str, right: str) -> Column:
    """floor(1000 * n * words / (left * right)), exactly: four numbers of at most 16 digits make decimals of at most 38."""
    whole = lambda c: f"CAST({c} AS DECIMAL(16,0))"
    return F.expr(f"({whole('n')} * {whole('words')} * 1000BD) div ({whole(left)} * {whole(right)})")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST) -> DataFrame:
    """The first phrases of each language by their lowest-scoring cut: lang, rank, phrase, a, l, r, n, score."""
    tables, words, _ = levels(docs, least, longest)
    scored = []
    for k in range(2, longest + 1):
        level = tables[k - 1]
        if k < longest:
            longer = tables[k]
            covers = longer.select(F.explode(F.array("left", "right")).alias("id"), F.col("n").alias("long")).groupBy("id").agg(F.max("long").alias("long"))
            level = level.join(covers.hint("merge"), "id", "left").where(F.col("long").isNull() | (F.col("long") < F.col("n")))
        level = level.join(F.broadcast(words) if _few(words) else words, "lang")
        cuts = [
            F.struct(
                cut_score(f"first{j}", f"rest{k - j}").alias("score"), F.lit(j).alias("cut"), F.col(f"first{j}").alias("l"), F.col(f"rest{k - j}").alias("r"),
            )
            for j in range(1, k)
        ]
        scored.append(level.withColumn("best", F.array_min(F.array(*cuts))).select("lang", "phrase", F.col("n").alias("a"), "best.l", "best.r", F.col("words").alias("n"), F.col("best.score").alias("score")))
    found = scored[0]
    for s in scored[1:]:
        found = found.unionByName(s)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return top.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _few(words: DataFrame) -> bool:
    """Whether the table of languages is small enough to broadcast."""
    return words.limit(10_001).count() <= 10_000
