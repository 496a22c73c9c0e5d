"""Finding every window of L consecutive symbols that repeats in a corpus, without moving the corpus.

Shared by the two exact substring operators (words with suffix automata, bytes with suffix arrays).

* Anchors. Of each window's k-grams, the one with the least hash (leftmost of equals) is its anchor, so equal windows
  have equal anchors at equal places. Consecutive windows with one anchor form a piece, its content the text they span.
* Questions. Each chunk asks once about each distinct key (at first the anchor's hash): the content's hash if the chunk
  has one content under that key, else only how many. A bucket answers which contents stand elsewhere as a whole (all
  their windows go) and which share a key with a different content. One piece stands for all equal ones.
* Shards. Pieces that share a key go to buckets by key; each bucket is a shard that the operator's method judges.
* Splits. A key with over ``GROUP`` contents would fill a task, so its pieces are cut by the place of the anchor in the
  window, and the parts are keyed by all the text that the windows of a part share; then the questions begin anew, with
  what is left of each chunk. A part of one window has one content under its key, so this ends after a few rounds.
* End. Each chunk gets its settled stretches and judged windows and removes what they cover.

A chunk sends each key once, so no task's share follows a passage's frequency. Hashes of pairs are 96 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BLOB_SCHEMA, NULL_ID, U, Chunk, answer_per_bucket, blob_batch, chunk_rows, corpus_bytes, from48, mix, pack_arrays, powers, sliding_min, stage, stage_chunks, to48, unpack_arrays, with_answers,
)

#: Different contents of one key that a shard judges together; more are split by further text.
GROUP = 256
#: Window starts that are looked at together: bounds memory, not results.
SLICE = 1 << 19


@dataclass(frozen=True)
class Method:
    """What tells the two operators apart."""

    name: str
    length: int  # L
    gram: int  # k
    symbols: Callable[[Chunk], tuple[np.ndarray, np.ndarray]]  # symbols of a chunk on end, and how many each document has
    grams: Callable[[np.ndarray], np.ndarray]  # hash of each k-gram of a slice
    ordered: bool  # True: only a smaller doc_id counts as elsewhere; False: any other place does
    content: Callable[[np.ndarray], np.ndarray]  # symbols as they travel
    symbols_of: Callable[[np.ndarray], np.ndarray]  # and back
    judge: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    bucket_bytes: int = 16 << 20


@dataclass
class Pieces:
    """Runs of windows: first window start (place in the chunk), how many, place of the anchor in the first window,
    where their content begins in ``sym``, key and content hash (48 bits), and whose (doc_id, or how many places)."""

    first: np.ndarray
    n: np.ndarray
    offset: np.ndarray
    at: np.ndarray
    key: np.ndarray
    x: np.ndarray
    who: np.ndarray
    sym: np.ndarray


def anchors(sym: np.ndarray, counts: np.ndarray, m: Method, ids: np.ndarray) -> Pieces:
    """The pieces of a chunk, keyed by anchor. If order counts, documents without doc_id have none."""
    ends = np.cumsum(counts)
    L, k, w = m.length, m.gram, m.length - m.gram + 1
    out_of = (ids == NULL_ID) & m.ordered
    got = []
    for at in range(0, max(0, len(sym) - L + 1), SLICE):
        part = sym[at : at + SLICE + L - 1]
        g = m.grams(part)
        n = len(part) - L + 1
        key = (g & ~U((1 << 20) - 1)) | np.arange(len(g), dtype=U)
        p = (sliding_min(key, w)[:n] & U((1 << 20) - 1)).astype(np.int64)
        d0, d1 = np.searchsorted(ends, [at, at + len(part) - 1], side="right")
        e = ends[d0 : d1 + 1] - at
        last = np.where(out_of[d0 : d1 + 1], -1, e)
        limit = np.repeat(last, np.diff(np.concatenate([[0], np.minimum(e, len(part))])))[:n]
        s = np.flatnonzero(limit - np.arange(n) >= L)
        if not len(s):
            continue
        ps = p[s]
        cut = np.flatnonzero((np.diff(ps) != 0) | (np.diff(s) != 1)) + 1
        a, b = s[np.concatenate([[0], cut])], s[np.concatenate([cut, [len(s)]]) - 1]
        pa_ = p[a]
        up, down = powers(SLICE + L)
        prefix = np.concatenate([np.zeros(1, U), np.cumsum(g * up[: len(g)])])
        x = mix((prefix[b + w] - prefix[a]) * down[a], ((pa_ - a) << 32 | (b - a)).astype(U))
        got.append((a + at, b - a + 1, pa_ - a, mix(g[pa_], g[pa_]) >> U(16), x >> U(16)))  # mixed anew: the least hashes are all small
    if not got:
        z = np.empty(0, np.int64)
        return Pieces(z, z, z, z, z.astype(U), z.astype(U), z, sym)
    first, n, offset, h, x = (np.concatenate(c) for c in zip(*got, strict=True))
    who = ids[np.searchsorted(ends, first, side="right")] if m.ordered else np.ones(len(first), np.int64)
    return Pieces(first, n, offset, first, h, x, who, sym)


def split(p: Pieces, shift: int, m: Method) -> Pieces:
    """Pieces cut where the anchor's place in the window passes a multiple of 2**shift, keyed by the text that all
    windows with the anchor in that range share."""
    L, w = m.length, m.length - m.gram + 1
    low = p.offset - p.n + 1
    parts = (p.offset >> shift) - (low >> shift) + 1
    r = np.repeat(np.arange(len(parts)), parts)
    node = (p.offset >> shift)[r] - (np.arange(len(r)) - np.repeat(np.cumsum(parts) - parts, parts))
    top, bottom = np.minimum(p.offset[r], ((node + 1) << shift) - 1), np.maximum(low[r], node << shift)
    skip = p.offset[r] - top
    out = Pieces(p.first[r] + skip, top - bottom + 1, top, p.at[r] + skip, p.key[r], p.key[r], p.who[r], p.sym)
    start = out.at + out.offset - (node << shift)
    end = out.at + out.offset - np.minimum(((node + 1) << shift) - 1, w - 1) + L
    key, x = np.empty(len(r), U), np.empty(len(r), U)
    up, down = powers(SLICE + L)
    at, last = 0, out.at + out.n + L - 1
    while at < len(r):  # as many pieces as fit in a slice of the content, which lies in order
        to = max(at + 1, int(np.searchsorted(last, out.at[at] + SLICE, side="right")))
        base = int(out.at[at])
        sym = p.sym[base : int(last[to - 1])].astype(U)
        prefix = np.concatenate([np.zeros(1, U), np.cumsum(mix(sym, sym) * up[: len(sym)])])
        b = slice(at, to)
        hash_of = lambda lo, hi: (prefix[hi - base] - prefix[lo - base]) * down[lo - base]  # noqa: B023, E731
        key[b] = mix(hash_of(start[b], end[b]), (node[b] << 8 | shift).astype(U) + p.key[r][b])
        x[b] = mix(hash_of(out.at[b], last[b]), (out.offset[b] << 32 | out.n[b]).astype(U))
        at = to
    out.key, out.x = key >> U(16), x >> U(16)
    return out


@dataclass
class Entries:
    """Pieces in order of (key, x); where each distinct pair and each distinct key begins; how many contents a key has."""

    order: np.ndarray
    pair: np.ndarray
    key: np.ndarray  # index into pair
    contents: np.ndarray

    @classmethod
    def of(cls, p: Pieces) -> Entries:
        order = np.lexsort((p.x, p.key))
        h, x = p.key[order], p.x[order]
        other = np.ones(len(h), bool)
        other[1:] = h[1:] != h[:-1]
        new = other.copy()
        new[1:] |= x[1:] != x[:-1]
        pair = np.flatnonzero(new)
        key = np.flatnonzero(other[pair])
        return cls(order, pair, key, np.diff(np.concatenate([key, [len(pair)]])))

    def best(self, p: Pieces, m: Method) -> np.ndarray:
        """For each pair: its least doc_id, or at how many places it stands (two stands for more)."""
        who = p.who[self.order]
        if m.ordered:
            return np.minimum.reduceat(who, self.pair)
        return np.minimum(np.add.reduceat(who, self.pair), 2)


def _cuts(h: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets that have some of the sorted 48-bit hashes, and which."""
    b = np.minimum((h.astype(np.float64) * (buckets / (1 << 48))).astype(np.int64), buckets - 1)
    if not len(b):
        return
    begin = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
    for i, j in zip(begin[:-1], begin[1:], strict=True):
        yield int(b[i]), slice(i, j)


def _small(a: np.ndarray) -> np.ndarray:
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.int64)


def _questions(c: int, p: Pieces, m: Method, buckets: int) -> pa.RecordBatch:
    e = Entries.of(p)
    at = e.order[e.pair[e.key]]
    h, x = p.key[at], np.where(e.contents == 1, p.x[at], U(0))
    who = e.best(p, m)[e.key]
    bucket, blobs = [], []
    for b, s in _cuts(h, buckets):
        mine = [_small(who[s])]
        if m.ordered:
            names, index = np.unique(who[s], return_inverse=True)
            mine = [np.diff(names, prepend=names[:1] * 0), _small(index)]
        blobs.append(pack_arrays([to48(h[s]), to48(x[s]), _small(e.contents[s]), *mine]))
        bucket.append(b)
    return blob_batch([c] * len(bucket), bucket, blobs)


ALL, JUDGE, SPLIT = 1, 2, 4


def _answer(m: Method, group: int):
    def run(chunks: list[int], blobs: list[bytes]) -> list[bytes]:
        got = [unpack_arrays(b) for b in blobs]
        h, x = (np.concatenate([from48(g[i].view(np.uint8)) for g in got]) for i in (0, 1))
        many = np.concatenate([g[2].astype(np.int64) for g in got])
        who = np.concatenate([np.cumsum(g[3])[g[4]] if m.ordered else g[3].astype(np.int64) for g in got])
        order = np.lexsort((x, many > 1, h))
        hs, xs, ws, ms = h[order], x[order], who[order], many[order]
        new_h = np.ones(len(hs), bool)
        new_h[1:] = hs[1:] != hs[:-1]
        new = new_h | (ms > 1)
        new[1:] |= xs[1:] != xs[:-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.concatenate([begin, [len(hs)]]))
        state = np.zeros(len(hs), np.uint8)
        one = ms == 1
        if m.ordered:
            stands = ws == np.repeat(np.minimum.reduceat(ws, begin), size)
            state[one & ~stands] |= ALL
        else:
            stands = new
            state[one & np.repeat(np.add.reduceat(ws, begin) >= 2, size)] |= ALL
        of_h = np.cumsum(new_h) - 1
        contents = np.bincount(of_h[begin], weights=ms[begin]).astype(np.int64)[of_h]
        state[stands & (contents > 1)] |= JUDGE
        state[stands & (contents > group)] ^= JUDGE | SPLIT
        out = np.empty_like(state)
        out[order] = state
        return [pack_arrays([s]) for s in np.split(out, np.cumsum([len(g[0]) // 6 for g in got])[:-1])]

    return run


#: Buckets of rows that no shard takes: stretches that go, and pieces that are split further.
SETTLED, LEFT = -2, -3


def _stretches(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Merged [first, end) as two rows."""
    if not len(first):
        return np.empty((2, 0), np.int64)
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > end[:-1]
    b = np.flatnonzero(new)
    return np.stack([first[b], end[np.concatenate([b[1:], [len(first)]]) - 1]])


def _settle(c: int, p: Pieces, answers: pa.Table, m: Method, buckets: int) -> Iterator[pa.RecordBatch]:
    """What the answers settle, questions to shards, and what is to be split."""
    e = Entries.of(p)
    by = sorted(zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True))
    state = np.concatenate([unpack_arrays(b)[0] for _, b in by])
    size = np.diff(np.concatenate([e.pair, [len(e.order)]]))
    each = np.repeat(np.repeat(state, e.contents), size)  # by place in order
    settled = (each & ALL) > 0
    best = np.repeat(e.best(p, m), size)
    if m.ordered:
        settled |= p.who[e.order] > best
        stands = p.who[e.order] == best
    else:
        settled |= best > 1
        stands = np.zeros(len(e.order), bool)
        stands[e.pair] = True
    gone = e.order[settled]
    yield blob_batch([c], [SETTLED], [pack_arrays([_stretches(p.first[gone], p.first[gone] + p.n[gone] + m.length - 1).reshape(-1)])])
    who = p.who.copy()
    if not m.ordered:
        who[e.order] = np.where(settled, 2, 1)

    def blob(r: np.ndarray) -> bytes:
        lens = p.n[r] + m.length - 1
        ends = np.cumsum(lens)
        idx = np.arange(ends[-1]) - np.repeat(ends - lens, lens) + np.repeat(p.at[r], lens)
        return pack_arrays([to48(p.key[r]), p.first[r].astype(np.int64), p.n[r].astype(np.int32), who[r], m.content(p.sym[idx]), p.offset[r].astype(np.int32)])

    pick = e.order[stands & ((each & JUDGE) > 0)]  # sorted by key
    for b, s in _cuts(p.key[pick], buckets):
        yield blob_batch([c], [b], [blob(pick[s])])
    pick = e.order[stands & ((each & SPLIT) > 0)]
    if len(pick):
        yield blob_batch([c], [LEFT], [blob(pick)])


def _left(blob: bytes, m: Method) -> Pieces:
    """Pieces out of a blob that ``_settle`` has made."""
    key, first, n, who, content, offset = unpack_arrays(blob)
    n = n.astype(np.int64)
    lens = n + m.length - 1
    key = from48(key.view(np.uint8))
    return Pieces(first, n, offset.astype(np.int64), np.cumsum(lens) - lens, key, key, who, m.symbols_of(content))


def _shard(m: Method):
    """Judge a bucket's pieces; answer each chunk with the places of windows that go."""

    def run(chunks: list[int], blobs: list[bytes]) -> list[bytes]:
        got = [unpack_arrays(b) for b in blobs]
        h = np.concatenate([from48(g[0].view(np.uint8)) for g in got])
        first, n, who = (np.concatenate([g[i] for g in got]) for i in (1, 2, 3))
        content = np.concatenate([g[4] for g in got])
        gone = m.judge(h, n.astype(np.int64), who, content, n.astype(np.int64) + m.length - 1)
        ends = np.cumsum(n)
        place = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(first, n)
        src = np.repeat(np.arange(len(got)), [int(g[2].sum()) for g in got])
        cut = np.searchsorted(src[gone], np.arange(1, len(got)))
        return [pack_arrays([x]) for x in np.split(place[gone], cut)]

    return run


def _again(left: DataFrame, shift: int, m: Method, buckets: int, group: int) -> DataFrame:
    """Questions, answers and what they settle for the parts of the pieces that are left."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                yield _questions(c, split(_left(x, m), shift, m), m, buckets)

    def settle(key: tuple, mine: pa.Table, right: pa.Table) -> pa.Table:
        out = [r for x in mine.column("blob").to_pylist() for r in _settle(key[0].as_py(), split(_left(x, m), shift, m), right, m, buckets)]
        return pa.Table.from_batches(out or [blob_batch([], [], [])])

    answers = answer_per_bucket(left.mapInArrow(ask, BLOB_SCHEMA), _answer(m, group))
    return left.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(settle, BLOB_SCHEMA)


def removed(docs: DataFrame, m: Method, finish: Callable[[Chunk, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str, keep: bool = False, group: int = GROUP) -> DataFrame:
    """Apply m to docs. finish(chunk, symbols, counts, gone) makes a chunk's rows; gone marks removed symbols."""
    buckets = max(8, corpus_bytes(docs) // m.bucket_bytes)
    chunks = stage_chunks(docs, m.name, max(8, buckets), keep)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, chunk in chunk_rows(batches):
            p = anchors(*m.symbols(chunk), m, chunk.ids)
            if len(p.first):
                yield _questions(c, p, m, buckets)

    def settle(c: int, chunk: Chunk, right: pa.Table) -> Iterator[pa.RecordBatch]:
        p = anchors(*m.symbols(chunk), m, chunk.ids)
        if len(p.first):
            yield from _settle(c, p, right, m, buckets)

    asked = chunks.mapInArrow(ask, BLOB_SCHEMA)
    found = stage(with_answers(chunks, answer_per_bucket(asked, _answer(m, group)), settle, BLOB_SCHEMA), m.name)
    rounds = [found]
    width = (m.length - m.gram).bit_length()
    for shift in sorted({max(0, width - 2 * i) for i in range(1, width + 1)}, reverse=True):
        left = found.where(F.col("bucket") == LEFT)
        if left.limit(1).count() == 0:
            break

        found = stage(_again(left, shift, m, buckets, group), m.name)
        rounds.append(found)
    every = rounds[0]
    for x in rounds[1:]:
        every = every.unionByName(x)
    judged = answer_per_bucket(every.where("bucket >= 0"), _shard(m))
    settled = every.where(F.col("bucket") == SETTLED)
    back = settled.unionByName(judged)

    def end(c: int, chunk: Chunk, right: pa.Table) -> Iterator[pa.RecordBatch]:
        sym, counts = m.symbols(chunk)
        edge = np.zeros(len(sym) + 1, np.int32)
        for bucket, blob in zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist(), strict=True):
            x = unpack_arrays(blob)[0].astype(np.int64)
            lo, hi = x.reshape(2, -1) if bucket == SETTLED else (x, x + m.length)
            np.add.at(edge, lo, 1)
            np.add.at(edge, hi, -1)
        yield finish(chunk, sym, counts, np.cumsum(edge[:-1]) > 0)

    return with_answers(chunks, back, end, schema)
