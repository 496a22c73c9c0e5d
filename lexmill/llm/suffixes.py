"""Operator 3: suffix-array dedup over bytes, with longest-previous-factor arrays.

A byte is removed if a ``WINDOW``-byte string over it also starts in a document with a smaller doc_id, so of each
repeated string the copies in the first document stay. ``repeats`` deals the stretches whose anchors repeat to
buckets; a bucket sorts the suffixes that start its windows, takes the longest common prefixes of neighbours, and
finds for each suffix the previous and the next one in suffix order that belong to an earlier document. The longer
of the two common prefixes is its longest previous factor; a window goes if that reaches its length.

Null texts count as empty. A row without doc_id is neither earlier nor later than any: it keeps all its bytes and takes
none from others. Rows that repeat a doc_id aren't earlier than
each other, so of equal texts under one doc_id neither loses to the other. A very long text is a chunk of its own, its
windows looked at in slices. Ties can't arise: a byte goes or stays. Empty tables give empty results; other columns may have any names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import U, Chunk, mix
from .repeats import GROUP, Method, removed

WINDOW = 50
GRAM = 20


def previous_factors(lcp: np.ndarray, when: np.ndarray, least: int = 1) -> np.ndarray:
    """Longest previous factor of each suffix, in suffix order. lcp[i]: common prefix of suffixes i-1 and i (lcp[0]
    is 0). when: what makes a suffix earlier. Factors under ``least`` may be given as 0.

    Previous smaller positions by pointer jumping (each round follows the pointer of the one pointed at), with the
    least lcp on the way; next smaller positions likewise from the other end.
    """

    def side(lcp: np.ndarray, when: np.ndarray) -> np.ndarray:
        n = len(when)
        at, low = np.arange(-1, n - 1), lcp.copy()
        live = np.flatnonzero((at >= 0) & (low >= least))
        low[(at < 0) | (low < least)] = 0
        while len(live):
            live = live[when[at[live]] >= when[live]]
            to = at[live]
            low[live] = np.minimum(low[live], low[to])
            at[live] = at[to]
            dead = (at[live] < 0) | (low[live] < least)
            low[live[dead]] = 0
            live = live[~dead]
        return low

    back = np.concatenate([lcp[1:], [0]])[::-1]
    return np.maximum(side(lcp, when), side(back, when[::-1])[::-1]) if len(when) else lcp


def longest_previous_factors(text: bytes) -> np.ndarray:
    """The longest previous factor at each byte of one text: the longest string that also starts earlier."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    rank = np.frombuffer(text, np.uint8).astype(np.int64) + 1
    k = 1
    while True:  # prefix doubling
        pair = rank * (max(n, 256) + 2) + np.concatenate([rank[k:], np.zeros(min(k, n), np.int64)])
        _, rank = np.unique(pair, return_inverse=True)
        rank = rank + 1
        if rank.max() == n or k >= n:
            break
        k *= 2
    order = np.argsort(rank)
    lcp, h, pos = np.zeros(n, np.int64), 0, rank - 1
    for i in range(n):  # neighbours' common prefixes in text order
        if pos[i]:
            j = order[pos[i] - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            lcp[pos[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    out = np.empty(n, np.int64)
    out[order] = previous_factors(lcp, order)
    return out


def _eight(b: np.ndarray) -> np.ndarray:
    """Big-endian number of the eight bytes from each place."""
    n = len(b) - 7
    out = np.empty(max(n, 0), U)
    raw = b.tobytes()
    for o in range(min(8, max(n, 0))):
        m = (len(raw) - o) // 8
        out[o::8] = np.frombuffer(raw, ">u8", m, o)[: len(out[o::8])]
    return out


def _leading(x: np.ndarray) -> np.ndarray:
    """Leading bytes that are zero in each number."""
    return np.sum([x < U(1 << (8 * i)) for i in range(1, 8)], axis=0) + (x == 0)


def _judge(h: np.ndarray, windows: np.ndarray, who: np.ndarray, content: np.ndarray, lens: np.ndarray, least: int = WINDOW) -> np.ndarray:
    """Which windows of the contexts also start in an earlier document's context."""
    eight = _eight(content)
    ends = np.cumsum(windows)
    start = np.arange(ends[-1]) - np.repeat(ends - windows, windows) + np.repeat(np.cumsum(lens) - lens, windows)
    when = np.repeat(who, windows)
    at = [*range(0, least - 7, 8), *([least - 8] if least % 8 else [])]
    keys = [eight[start + o] for o in at]
    order = np.lexsort(keys[::-1])
    lcp = np.zeros(len(order), np.int64)
    same = np.ones(max(len(order) - 1, 0), bool)
    for o, k in zip(at, keys, strict=True):
        s = k[order]
        x = s[1:] ^ s[:-1]
        lcp[1:][same] = (o + _leading(x))[same]
        same &= x == 0
    lcp[1:][same] = least
    out = np.empty(len(order), bool)
    out[order] = previous_factors(lcp, when[order], least) >= least
    return out


def method(window: int = WINDOW, gram: int = GRAM) -> Method:
    if not 17 <= gram <= 24 or window < gram + 8:
        raise ValueError("gram must be 17 to 24 and window larger by 8 at least")

    def grams(s: np.ndarray) -> np.ndarray:
        e = _eight(s)
        n = len(s) - gram + 1
        if n <= 0:
            return np.empty(0, U)
        return mix(mix(e[:n], e[8 : 8 + n]), e[gram - 8 : gram - 8 + n])

    def symbols(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(chunk.body, np.uint8), chunk.lens

    def judge(h: np.ndarray, n: np.ndarray, who: np.ndarray, content: np.ndarray, lens: np.ndarray) -> np.ndarray:
        return _judge(h, n, who, content, lens, window)

    return Method("suffixes", window, gram, symbols, grams, True, lambda s: s, lambda s: s, judge)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left; a cut may fall inside a character)."""

    def finish(chunk: Chunk, sym: np.ndarray, counts: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
        body, n, spans, sha, kept = chunk.body, [], [], [], []
        for a, b in zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True):
            g = gone[a:b]
            if g.any():
                step = np.diff(np.concatenate([[0], g.view(np.int8), [0]]))
                lo, hi = np.flatnonzero(step > 0), np.flatnonzero(step < 0)
                left = b"".join(body[a + x : a + y] for x, y in zip([0, *hi.tolist()], [*lo.tolist(), b - a], strict=True))
                n.append(b - a - len(left))
                spans.append(len(lo))
            else:
                left = body[a:b]
                n.append(0)
                spans.append(0)
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        return pa.RecordBatch.from_pydict({
            "doc_id": chunk.doc_ids(), "n_bytes": pa.array(chunk.lens), "n_removed": pa.array(n, pa.int64()), "n_spans": pa.array(spans, pa.int64()),
            "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.binary()),
        })

    return removed(docs, method(window, gram), finish, RESULT, group=group)
