"""Operator 1: benchmark decontamination by CGK embedding and bit-sampling LSH, with exact edit verification.

Texts and items are word sequences (lower case, runs of letters and digits). A window of an item's size counts as a
leak if the item stands in or around it with at most ``1 - SIMILARITY`` of its words edited. Candidate windows are
those on the diagonal of a shared run of words: with so few edits, an item of n words and e edits keeps an unedited
run of ceil((n-e)/(e+1)) words, so no leak lacks one. Items are cut into pieces of at most ``PIECE`` words; some piece
of a leak has at most its own share of the edits, so its windows stand for the item's. They may reach over either end of
a document. Windows are embedded by CGK random walks (each step copies a word and moves on or stays by a random bit of
step and word), which map edit distance to Hamming distance; bit sampling keeps a window if a sample of any of ``WALKS``
walks agrees with the piece's embedding. The number of walks follows from ``RECALL``. What remains is verified
exactly by a bit-parallel search that gives the least edit distance of the item within the window's surroundings.

Where a run stands several times in a piece, as in a table or a chorus, its windows are taken as an interval of
starts; intervals of neighbouring places are joined at once, and one wider than ``WIDE`` is verified without samples. So
the work grows with the words of a text times the pieces that hold its runs, not with the pairs of equal runs. Of several
best places of an item in a text the first counts.

The items go to the tasks as a broadcast of at most ``BLOCK_BYTES``; a larger benchmark is taken in blocks of that
size, one scan each. Null texts and items, and items without words, match nothing. Repeated rows
match each on their own. Empty tables give empty results; other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, plain_docs, run_hashes, word_hashes

SIMILARITY = 0.8
#: Share of leaks, each with as many edits as the bound allows, that are to pass the samples.
RECALL = 0.99
#: Words of an item's piece, at most.
PIECE = 64
SAMPLES, POSITIONS = 8, 2
#: Measured: the least share of such leaks that one walk's samples pass, over sizes and places of the edits.
CATCH = 0.5
WALKS = math.ceil(math.log(1 - RECALL) / math.log(1 - CATCH))
#: Bytes of benchmark items, as broadcast, that one scan takes.
BLOCK_BYTES = 32 << 20
#: Bytes of an item's piece and of each word.
PIECE_BYTES, WORD_BYTES = 2 * WALKS * SAMPLES * POSITIONS + 40, 32
#: Windows that are walked at once; places of runs that are looked at together.
ROWS, PAIRS = 8192, 500_000
#: Starts on end that are walked one by one; more are verified as a whole.
WIDE = 256
#: Places of a run in a piece that are at most so far apart make one interval.
GAP = 8
GRAM = 3
SEED = 20

_FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def item_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_FOLD).split()


def edits(n: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * n + 1e-9)


def unedited_run(n: int, e: int) -> int:
    return -(-(n - e) // (e + 1))


def _bits(step: int, words: np.ndarray) -> np.ndarray:
    """The random bit of each word at this step of the walk."""
    x = (words + U(step * 2 + 1)) * U(0x9E3779B97F4A7C15)
    x ^= x >> U(31)
    x *= U(0xBF58476D1CE4E5B9)
    return (x >> U(40)).astype(np.int64) & 1


def walk_words(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, end: np.ndarray, steps: int, walk: int) -> tuple[np.ndarray, np.ndarray]:
    """CGK walk over words[start:start+size] of each row: by step, the word (0 outside first:end or once ended) and the place."""
    seen, at = np.zeros((steps, len(starts)), U), np.zeros((steps, len(starts)), np.uint8)
    i = np.zeros(len(starts), np.int64)
    for t in range(steps):
        live, p = i < sizes, starts + i
        inside = live & (p >= first) & (p < end)
        w = np.where(inside, words[np.where(inside, p, 0)], U(0))
        seen[t], at[t] = w, i
        i += _bits(walk * 2 * PIECE + t, w) & live
    return seen, at


@dataclass
class Items:
    """Items of one scan: ids, words on end, their pieces, and for each length of run the sorted runs, each with a piece and its
    first and last place there.

    Of an embedding only the sampled steps are kept, with the places in the piece where the walk stands then."""

    ids: list[int]
    words: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    of_piece: np.ndarray  # item of each piece
    piece_starts: np.ndarray
    piece_sizes: np.ndarray
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    samples: np.ndarray  # piece, walk, sample, position: step
    places: np.ndarray  # the same: place in the piece

    @classmethod
    def of(cls, rows: list[tuple[int, str]], similarity: float = SIMILARITY) -> Items | None:
        pairs = [(i, w) for i, t in rows if (w := item_words(t))]
        if not pairs:
            return None
        sizes = np.array([len(w) for _, w in pairs], np.int64)
        starts = np.cumsum(sizes) - sizes
        words = np.concatenate([word_hashes(w) for _, w in pairs])
        n = -(-sizes // PIECE)
        item = np.repeat(np.arange(len(sizes)), n)
        k = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        cut, end = k * sizes[item] // n[item], (k + 1) * sizes[item] // n[item]
        first, size = starts[item] + cut, end - cut
        by_run: dict[int, list[int]] = {}
        for j, m in enumerate(size.tolist()):
            by_run.setdefault(min(GRAM, unedited_run(m, edits(m, similarity))), []).append(j)
        runs = {}
        for length, found in by_run.items():
            lists = [run_hashes(words[first[j] : first[j] + size[j]], length) for j in found]
            h = np.concatenate(lists)
            piece = np.repeat(np.array(found, np.int32), [len(x) for x in lists])
            place = np.concatenate([np.arange(len(x), dtype=np.int32) for x in lists])
            order = np.lexsort((place, piece, h))
            h, piece, place = h[order], piece[order], place[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (piece[1:] != piece[:-1]) | (np.diff(place) > GAP)
            head = np.flatnonzero(new)
            runs[length] = (h[head], piece[head], place[head], place[np.append(head[1:], len(h)) - 1])
        rng = np.random.default_rng(SEED)
        samples = np.empty((len(size), WALKS, SAMPLES, POSITIONS), np.uint8)
        places = np.empty_like(samples)
        for at in range(0, len(size), ROWS):
            b = slice(at, at + ROWS)
            rows_ = np.arange(len(size[b]))[:, None, None]
            for walk in range(WALKS):
                _, i = walk_words(words, first[b], size[b], first[b], first[b] + size[b], int(2 * size[b].max()), walk)
                live = np.minimum((i < size[b]).sum(0), 2 * size[b])  # steps before the walk has ended
                t = (rng.random((len(live), SAMPLES, POSITIONS)) * live[:, None, None]).astype(np.int64)
                samples[b, walk], places[b, walk] = t, i[t, rows_]
        return cls([i for i, _ in pairs], words, starts, sizes, item, first, size, runs, samples, places)

    def mask(self, i: int) -> dict[int, int] | LongMask:
        x = self.words[self.starts[i] : self.starts[i] + self.sizes[i]].tolist()
        if len(x) > LongMask.LEAST:
            return LongMask(x)
        m: dict[int, int] = {}
        for p, w in enumerate(x):
            m[w] = m.get(w, 0) | 1 << p
        return m


class LongMask:
    """The places of each word of a long item. A word's bits are set when it is asked for, since all together grow with the
    square; those of words with more places than the root of the item's length are kept, of which there are at most as many."""

    LEAST = 4096

    def __init__(self, words: list[int]):
        self.at: dict[int, list[int]] = {}
        for p, w in enumerate(words):
            self.at.setdefault(w, []).append(p)
        self.bytes = len(words) // 8 + 1
        self.common = math.isqrt(len(words))
        self.kept: dict[int, int] = {}

    def get(self, word: int, other: int) -> int:
        if word not in self.at:
            return other
        if word in self.kept:
            return self.kept[word]
        bits = bytearray(self.bytes)
        for p in self.at[word]:
            bits[p >> 3] |= 1 << (p & 7)
        found = int.from_bytes(bits, "little")
        if len(self.at[word]) > self.common:
            self.kept[word] = found
        return found


def best_match(mask: dict[int, int] | LongMask, n: int, text: list[int]) -> tuple[int, int]:
    """(least edit distance of the item to any stretch of text, end of that stretch), bit-parallel."""
    full = (1 << n) - 1
    top = 1 << (n - 1)
    up, down, score, best, at = full, 0, n, n, 0
    for i, w in enumerate(text):
        eq = mask.get(w, 0)
        d0 = (((eq & up) + up) ^ up) | eq | down
        h_up = down | (~(d0 | up) & full)
        h_down = d0 & up
        if h_up & top:
            score += 1
        elif h_down & top:
            score -= 1
        h_up = h_up << 1 & full
        h_down = h_down << 1 & full
        up = h_down | (~(d0 | h_up) & full)
        down = h_up & d0
        if score < best:
            best, at = score, i + 1
    return best, at


def matches(text: str | None, items: Items, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int]]:
    """(item index, end word, words of the item, edits): the best match of each item that leaks into the text."""
    words = item_words(text)
    if not words:
        return []
    h = word_hashes(words)
    return _search(h, np.array([0, len(h)]), items, similarity).get(0, [])


def _search(h: np.ndarray, bounds: np.ndarray, items: Items, similarity: float, sampled: bool = True) -> dict[int, list[tuple[int, int, int, int]]]:
    """Leaks in documents laid end to end; bounds[i]:bounds[i+1] is document i. Unless sampled, every window is verified."""
    parts = [x for k, runs in items.runs.items() for x in _intervals(h, k, bounds, *runs)]
    if not parts:
        return {}
    d, j, s, upto = _joined(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    wide = upto - s >= WIDE
    several = [x[wide] for x in (d, j, s, upto)]
    d, j, s, upto = (x[~wide] for x in (d, j, s, upto))
    n = upto - s + 1
    s = np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    d, j = np.repeat(d, n), np.repeat(j, n)
    ok = np.ones(len(s), bool)
    if sampled:
        for at in range(0, len(s), ROWS):
            b = slice(at, at + ROWS)
            ok[b] = _passes(h, s[b], bounds[d[b]], bounds[d[b] + 1], j[b], items)
    d, j, s, upto = (np.concatenate([x, y]) for x, y in zip((d[ok], j[ok], s[ok], s[ok]), several, strict=True))
    i = items.of_piece[j]
    lead = items.piece_starts[j] - items.starts[i]
    # Where the whole item would begin; pieces that agree on it, or on starts next to it, are verified together.
    d, i, s, upto = _joined(d, i, s - lead, upto - lead)
    out: dict[int, dict[int, tuple[int, int, int]]] = {}
    done, mask = (-1, -1, -1), None  # document and item at hand, and up to where it has been searched
    for d_, i_, a, z in zip(d.tolist(), i.tolist(), s.tolist(), upto.tolist(), strict=True):
        n = int(items.sizes[i_])
        e = edits(n, similarity)
        lo, hi = max(int(bounds[d_]), a - e), min(int(bounds[d_ + 1]), z + n + e)
        if done[:2] != (d_, i_):
            mask = items.mask(i_)
        elif done[2] >= hi:
            continue
        done = d_, i_, hi
        score, end = best_match(mask, n, h[lo:hi].tolist())
        if score <= e and (i_ not in out.setdefault(d_, {}) or score < out[d_][i_][2]):
            out[d_][i_] = (lo + end - int(bounds[d_]), n, score)
    return {d_: [(i_, *v) for i_, v in sorted(x.items())] for d_, x in out.items() if x}


def _intervals(h: np.ndarray, k: int, bounds: np.ndarray, runs: np.ndarray, piece: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, piece, first start, last start) of windows on the diagonals of shared runs, some places at a time, joined.
    A window may begin before its document or end after it: the words that it lacks there are edits."""
    g = run_hashes(h, k) if k > 1 else h
    # A small table of bits first: most places hold no run of any item.
    size = 1 << max(16, int(len(runs)).bit_length() + 6)
    table = np.zeros(size, bool)
    table[(runs & U(size - 1)).astype(np.int64)] = True
    p = np.flatnonzero(table[(g & U(size - 1)).astype(np.int64)])
    lo, hi = np.searchsorted(runs, g[p], "left"), np.searchsorted(runs, g[p], "right")
    p, lo, hi = (x[hi > lo] for x in (p, lo, hi))
    ends = np.cumsum(hi - lo)
    at = 0
    while at < len(p):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = hi[at:to] - lo[at:to]
        r = np.repeat(lo[at:to], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        q = np.repeat(p[at:to], n)
        yield _joined(np.searchsorted(bounds, q, "right") - 1, piece[r].astype(np.int64), q - last[r], q - first[r])
        at = to


def _joined(d: np.ndarray, j: np.ndarray, s: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of one document and piece that touch or overlap, as one."""
    if not len(d):
        return d, j, s, upto
    order = np.lexsort((s, j, d))
    d, j, s, upto = d[order], j[order], s[order], upto[order]
    group = np.cumsum(np.concatenate([[True], (d[1:] != d[:-1]) | (j[1:] != j[:-1])]))
    # The furthest end so far inside a group: groups are laid so far apart that one maximum runs through all.
    apart = int(upto.max() - s.min()) + 3
    reach = np.maximum.accumulate(upto + group * apart) - group * apart
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (s[1:] > reach[:-1] + 1)])
    head = np.flatnonzero(new)
    return d[head], j[head], s[head], reach[np.append(head[1:], len(d)) - 1]


def _passes(h: np.ndarray, s: np.ndarray, first: np.ndarray, end: np.ndarray, j: np.ndarray, items: Items, walks: int = WALKS) -> np.ndarray:
    """Windows from s on whose embedding agrees with that of piece j in all positions of a sample."""
    ok = np.zeros(len(s), bool)
    for walk in range(walks):
        left = np.flatnonzero(~ok)
        if not len(left):
            break
        k, sizes = j[left], items.piece_sizes[j[left]]
        seen, _ = walk_words(h, s[left], sizes, first[left], end[left], int(2 * sizes.max()), walk)
        want = items.words[items.piece_starts[k][:, None, None] + items.places[k, walk]]
        ok[left] = (seen[items.samples[k, walk], np.arange(len(k))[:, None, None]] == want).all(2).any(1)
    return ok


def item_bytes(text: str, similarity: float = SIMILARITY) -> int:
    """Bytes that an item takes in a broadcast, about."""
    n = len(item_words(text))
    return WORD_BYTES * n + PIECE_BYTES * -(-n // PIECE)


def _blocks(benchmark: DataFrame, item: str, text: str, most: int | None = None) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most BLOCK_BYTES each (an item over that is a block of its own); one is on the driver at a time."""
    rows = benchmark.select(F.col(item).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null")
    most = BLOCK_BYTES if most is None else most
    block: list[tuple[int, str]] = []
    size = 0
    for r in rows.toLocalIterator():
        n = item_bytes(r["t"])
        if block and size + n > most:
            yield sorted(block)
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    if block:
        yield sorted(block)


def _scanner(shared, similarity: float):
    def scan(texts: list[str | None]) -> dict[int, list[tuple[int, int, int, int]]]:
        items = shared.value
        out: dict[int, list[tuple[int, int, int, int]]] = {}
        for at in range(0, len(texts), 128):
            lists = [item_words(t) for t in texts[at : at + 128]]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            h = word_hashes([w for x in lists for w in x])
            if len(h):
                out |= {at + d: v for d, v in _search(h, bounds, items, similarity).items()}
        return out

    return scan


LEAKS = "doc_id long, item_id long, first_word long, n_words long, edits long, similarity double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """A row for each document and item that leaks into it: its place (words from 0), the item's words, the edits."""
    sc, found = docs.sparkSession.sparkContext, None
    for block in _blocks(benchmark, "item_id", "text"):
        items = Items.of(block, similarity)
        if items is None:
            continue
        scan = _scanner(sc.broadcast(items), similarity)

        def run(batches: Iterator[pa.RecordBatch], scan=scan, ids=items.ids) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = scan(b.column(1).to_pylist())
                docs_, rows = b.column(0).to_pylist(), []
                for d, leaks in sorted(hits.items()):
                    rows += [(docs_[d], ids[i], max(0, end - n), n, e, 1 - e / n) for i, end, n, e in leaks]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in LEAKS.split(", ")])

        part = plain_docs(docs).mapInArrow(run, LEAKS)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], LEAKS)


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows that an item leaks into, all columns as they are."""
    at = docs.columns.index("text")
    for block in _blocks(benchmark, "item_id", "text"):
        items = Items.of(block, similarity)
        if items is None:
            continue
        scan = _scanner(docs.sparkSession.sparkContext.broadcast(items), similarity)

        def run(batches: Iterator[pa.RecordBatch], scan=scan) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = scan(b.column(at).to_pylist())
                yield b.filter(pa.array([i not in hits for i in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
