"""Operator 2: substring dedup over words, with suffix automata of reference shards.

Every run of ``WINDOW`` words that starts anywhere else too (same document included) is removed wherever it stands.
The reference is the corpus itself, so no bound on its size is known and its automata can't be broadcast whole:
``repeats`` cuts it to the stretches whose anchors repeat and deals these to shards. A shard builds a generalised
suffix automaton of its stretches, with the number of places of each state, streams the stretches through it for
matching statistics, and removes the spans matched elsewhere over the threshold. ``Automaton`` is also used alone:
``against`` broadcasts the automaton of a small reference (its size is checked) and streams documents through it.

Words are ``[^\\x20\\x09-\\x0D]+``. Null and blank texts have no words and are kept as empty. Rows that repeat a doc_id
or a text are other places. A very long text is a chunk of its own, its windows looked at in slices. Ties can't arise: a
word goes or stays. Empty tables give empty results; other columns may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Chunk, from48, own_columns, own_schema, plain_docs, run_hashes, to48, word_hashes, word_hashes_of, words_of
from .repeats import GROUP, Method, removed

WINDOW = 35
GRAM = 14
#: Words of a reference whose automaton may be broadcast.
BROADCAST_WORDS = 1_000_000


class Automaton:
    """Generalised suffix automaton of word sequences; counts at how many places each state's strings end."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.places = [0]

    def add(self, seq: list[int], weight: int = 1) -> list[int]:
        """Add a sequence that stands at ``weight`` places; the state of each of its prefixes."""
        nxt, link, length, places = self.next, self.link, self.length, self.places
        last, path = 0, []
        for c in seq:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
            elif q is not None:
                last = self._clone(last, c, q)
            else:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                places.append(0)
                link.append(0)
                p = last
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p != -1:
                    q = nxt[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
                last = cur
            places[last] += weight
            path.append(last)
        return path

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        self.places.append(0)
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def spread(self, least: int = 2) -> list[int]:
        """Sum places up the links; for each state the longest suffix length that ends at ``least`` places or more."""
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        for v in order:
            self.places[self.link[v]] += self.places[v]
        common = [0] * len(self.next)
        for v in reversed(order):
            common[v] = self.length[v] if self.places[v] >= least else common[self.link[v]]
        return common

    def matching(self, seq: list[int]) -> list[int]:
        """Length of the longest match that ends at each word of seq."""
        nxt, link, length = self.next, self.link, self.length
        v = m = 0
        out = []
        for c in seq:
            while v and c not in nxt[v]:
                v = link[v]
                m = length[v]
            if c in nxt[v]:
                v = nxt[v][c]
                m += 1
            out.append(m)
        return out


def _judge(h: np.ndarray, windows: np.ndarray, who: np.ndarray, content: np.ndarray, lens: np.ndarray, least: int = WINDOW) -> np.ndarray:
    """Which windows of the contexts stand at two places or more. who: 1 for a context at one place, else 2."""
    words = from48(content.view(np.uint8)).tolist()
    ends = np.cumsum(lens)
    starts = (ends - lens).tolist()
    ends = ends.tolist()
    out = np.zeros(int(windows.sum()), bool)
    base = (np.cumsum(windows) - windows).tolist()
    order = np.argsort(h, kind="stable")
    hs = h[order]
    cuts = np.concatenate([[0], np.flatnonzero(hs[1:] != hs[:-1]) + 1, [len(hs)]]).tolist()
    order, who, windows = order.tolist(), who.tolist(), windows.tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        group = order[a:b]
        if b - a < 2:
            continue
        auto = Automaton()
        paths = [(i, auto.add(words[starts[i] : ends[i]], who[i])) for i in group]
        common = auto.spread()
        length, places = auto.length, auto.places
        for i, path in paths:
            if who[i] > 1:  # settled as a whole
                out[base[i] : base[i] + windows[i]] = True
                continue
            for s in range(windows[i]):
                v = path[s + least - 1]
                if (s + least if places[v] >= 2 else common[v]) >= least:
                    out[base[i] + s] = True
    return out


def _symbols(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    h, first = word_hashes_of(chunk.body, chunk.starts, chunk.ends)
    counts = np.searchsorted(first, chunk.ends) - np.searchsorted(first, chunk.starts)
    return h & np.uint64((1 << 48) - 1), counts


def method(window: int = WINDOW, gram: int = GRAM) -> Method:
    def judge(h: np.ndarray, n: np.ndarray, who: np.ndarray, content: np.ndarray, lens: np.ndarray) -> np.ndarray:
        return _judge(h, n, who, content, lens, window)

    return Method("substring", window, gram, _symbols, lambda s: run_hashes(s, gram), False, to48, lambda b: from48(b.view(np.uint8)), judge)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep: bool = False, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, by single spaces; a text that loses none is
    kept as it stands); with keep, docs' own columns with the text replaced, and n_words and n_removed."""
    spec = docs.schema

    def finish(chunk: Chunk, sym: np.ndarray, counts: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        lost = np.add.reduceat(np.concatenate([gone, [False]]).astype(np.int64), np.concatenate([[0], np.cumsum(counts)[:-1]])) * (counts > 0) if len(counts) else counts
        ends = np.cumsum(counts)
        sha, kept = [], []
        for i, t in enumerate(chunk.texts()):
            words = t.split()
            if lost[i]:
                words = [w for w, g in zip(words, gone[ends[i] - counts[i] : ends[i]].tolist(), strict=True) if not g]
            left = b" ".join(words)
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left if lost[i] else None if chunk.null[i] else t)
        cols = {"doc_id": chunk.doc_ids(), "n_words": pa.array(counts), "n_removed": pa.array(lost)}
        text = pa.array(kept, pa.binary()).cast(pa.string())
        if not keep:
            return pa.RecordBatch.from_pydict(cols | {"kept_sha256": pa.array(sha, pa.string()), "kept": text})
        own = own_columns(chunk, spec, text)
        return pa.RecordBatch.from_arrays([*own, cols["n_words"], cols["n_removed"]], [f"c{j}" for j in range(len(own) + 2)])

    if not keep:
        return removed(docs, method(window, gram), finish, RESULT, group=group)
    schema = own_schema(spec, 2)
    out = removed(docs, method(window, gram), finish, schema, True, group)
    names = [f.name for f in spec]
    extra = [next(n for i in range(999) if (n := x + "_" * i) not in names) for x in ("n_words", "n_removed")]
    return out.toDF(*names, *extra)


def against(docs: DataFrame, reference: list[str], window: int = WINDOW) -> DataFrame:
    """doc_id, start, length: maximal spans of at least ``window`` words that stand in a small reference as well."""
    hashes = [word_hashes(words_of(t.encode())).tolist() for t in reference]
    if sum(map(len, hashes)) > BROADCAST_WORDS:
        raise ValueError(f"the reference has over {BROADCAST_WORDS} words; use substring_dedup on the union instead")
    auto = Automaton()
    for x in hashes:
        auto.add(x)
    shared = docs.sparkSession.sparkContext.broadcast(auto)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                m = shared.value.matching(word_hashes(words_of(t)).tolist())
                lo = hi = -1
                for e, n in enumerate(m):
                    if n >= window:
                        if e - n + 1 > hi:
                            if hi > lo:
                                rows.append((d, lo, hi - lo))
                            lo = e - n + 1
                        hi = e + 1
                if hi > lo:
                    rows.append((d, lo, hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], ["doc_id", "start", "length"])

    return plain_docs(docs).mapInArrow(run, "doc_id long, start long, length long")
