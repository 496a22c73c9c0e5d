"""Operator 4: language-model scores by deleted interpolation.

A token's probability mixes the bigram and unigram maximum-likelihood estimates and a uniform one. The weights
depend on how often the context was seen (buckets by powers of two) and are learned by expectation-maximisation on
held-out counts: one fold of the training documents is scored with counts of the other folds.

Counts cover all training documents. Each chunk asks hash buckets once about its distinct words and bigrams, packed,
with its own counts; the answers carry the corpus's counts back to the chunk, so no table of counts is broadcast and
a frequent word or bigram costs each chunk one entry. What EM needs is a histogram over (context bucket, ratio of
bigram to uniform, ratio of unigram to uniform) in quarter powers of two: its size has a bound that doesn't depend
on the corpus. The order is two: a trigram model's questions would pass the budget of disk.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; each text ends with an end token, which is also the context of
the first word. Null texts count as empty (the end token alone). A null doc_id is never trained on and never held
out. Rows that repeat count each time. Without training documents all counts are 0 and the model is uniform. A very long
text is a chunk of its own and scored whole. Ties can't arise. An empty table gives an empty result; columns other than
doc_id and text take no part, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BLOB_SCHEMA, NULL_ID, U, Chunk, blob_batch, chunk_rows, corpus_bytes, mix, pack_arrays, pack_sorted, stage, stage_chunks, unpack_arrays, unpack_sorted, with_answers, word_hashes_of,
)

FOLDS, HELD, DELETED = 5, 1, 0
#: Text of one chunk, and text whose questions one bucket answers.
CHUNK_BYTES, BUCKET_BYTES = 2 << 20, 6 << 20
CONTEXTS = 48
STEP = 4  # bins for each power of two
LOW, BINS = -64, 512


def folds(ids: np.ndarray, n: int = FOLDS) -> np.ndarray:
    """CRC-32 of the id as text, modulo n; -1 for null."""
    return np.array([-1 if i == NULL_ID else zlib.crc32(str(i).encode()) % n for i in ids.tolist()], np.int64)


#: The end token's hash.
END = U(0x5851F42D4C957F2D)


def _numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order and each one's place among them. Only what is different is sorted."""
    code, values = pd.factorize(h)
    order = np.argsort(values)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return values[order], rank[code]


class Tokens:
    """A chunk's tokens: word and context hashes on end, each document's closed by the end token."""

    def __init__(self, chunk: Chunk):
        h, first = word_hashes_of(chunk.body.lower(), chunk.starts, chunk.ends)
        # A document's words, then its end token.
        n = np.searchsorted(first, chunk.ends) - np.searchsorted(first, chunk.starts)
        self.counts = n + 1
        ends = np.cumsum(self.counts) - 1
        self.word = np.full(int(self.counts.sum()), END, U)
        own = np.ones(len(self.word), bool)
        own[ends] = False
        self.word[own] = h
        self.fold = np.repeat(folds(chunk.ids), self.counts)
        self.starts = np.cumsum(self.counts) - self.counts
        self.words, self.w = _numbered(self.word)
        # A token's context is the token before it, the end token at a text's head.
        self.v = np.empty_like(self.w)
        self.v[1:] = self.w[:-1]
        if len(self.starts):
            self.v[self.starts] = np.searchsorted(self.words, END)
        self.pairs, self.p = _numbered(mix(self.words[self.v], self.word))


def _shares(h: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets that have some of the sorted hashes, and which."""
    if not len(h):
        return
    b = np.minimum((h.astype(np.float64) * (buckets / 2.0**64)).astype(np.int64), buckets - 1)
    begin = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
    for i, j in zip(begin[:-1], begin[1:], strict=True):
        yield int(b[i]), slice(i, j)


def _small(a: np.ndarray) -> np.ndarray:
    top = int(a.max(initial=0))
    return a.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.int64)


def _ask(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, chunk in chunk_rows(batches):
            t = Tokens(chunk)
            train = (t.fold >= 0) & (t.fold != HELD)
            kept = train & (t.fold != DELETED)
            at, blobs = [], []
            for kind, (keys, of) in enumerate(((t.words, t.w), (t.pairs, t.p))):
                n = [np.bincount(of[m], minlength=len(keys)) for m in (train, kept)]
                for b, s in _shares(keys, buckets):
                    at.append(b + kind * buckets)
                    blobs.append(pack_arrays([pack_sorted(keys[s], 8) if kind == 0 else pack_sorted(keys[s] >> U(8), 7), _small(n[0][s]), _small(n[1][s])]))
            yield blob_batch([c] * len(at), at, blobs)

    return run


STATS = -1


def _answers(asked: DataFrame, buckets: int) -> DataFrame:
    """Corpus counts for each chunk's keys; from word buckets also totals, as rows of chunk -1."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        width = 8 if bucket < buckets else 7
        chunks = t.column("chunk").to_pylist()
        got = [unpack_arrays(b) for b in t.column("blob").to_pylist()]
        lens = [len(g[0]) // width for g in got]
        keys = np.concatenate([unpack_sorted(g[0], width) for g in got])
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        begin, of = np.flatnonzero(new), np.cumsum(new) - 1
        sums, back = [], []
        for i in (1, 2):
            n = np.add.reduceat(np.concatenate([g[i].astype(np.int64) for g in got])[order], begin)
            sums.append(n)
            full = np.empty(len(s), np.int64)
            full[order] = n[of]
            back.append(np.split(full, np.cumsum(lens)[:-1]))
        blobs = [pack_arrays([_small(a), _small(b)]) for a, b in zip(*back, strict=True)]
        if bucket < buckets:
            chunks = [*chunks, STATS]
            blobs.append(pack_arrays([np.array([sums[0].sum(), (sums[0] > 0).sum(), sums[1].sum()], np.int64)]))
        return pa.Table.from_batches([blob_batch(chunks, [bucket] * len(chunks), blobs)])

    return asked.groupBy("bucket").applyInArrow(run, BLOB_SCHEMA)


def _counts(t: Tokens, right: pa.Table, buckets: int) -> tuple[np.ndarray, ...]:
    """Training and kept counts of the chunk's words, then of its bigrams."""
    rows = sorted(zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist(), strict=True))
    out = []
    for kind in (0, 1):
        got = [unpack_arrays(b) for k, b in rows if (k >= buckets) == bool(kind)]
        out += [np.concatenate([g[i].astype(np.int64) for g in got]) if got else np.empty(0, np.int64) for i in (0, 1)]
    return tuple(out)


def _context(c: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than the whole part of the count's binary logarithm."""
    return np.minimum(np.where(c > 0, np.frexp(np.maximum(c, 1).astype(np.float64))[1], 0), CONTEXTS - 1)


def _bin(ratio: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        b = np.floor(np.log2(ratio) * STEP) - LOW * STEP
    return np.where(ratio > 0, np.clip(b, 1, BINS - 1), 0).astype(np.int64)


def _value(b: np.ndarray) -> np.ndarray:
    return np.where(b > 0, 2.0 ** ((b + LOW * STEP + 0.5) / STEP), 0.0)


def fit(hist: list[tuple[int, int]], rounds: int = 100) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) of each context bucket from (code, count), by EM. A bucket without
    held-out tokens takes its lower neighbour's weights; each estimate gets a pseudo-count, so none is quite 0."""
    code = np.array([c for c, _ in hist], np.int64)
    n = np.array([k for _, k in hist], np.float64)
    ctx, r2, r1 = code // (BINS * BINS), _value(code // BINS % BINS), _value(code % BINS)
    weights = np.tile(np.array([0.0, 0.9, 0.1]), (CONTEXTS, 1))
    last = weights[0]
    for b in range(CONTEXTS):
        m = ctx == b
        if not m.any():
            weights[b] = last
            continue
        parts = np.stack([r2[m], r1[m], np.ones(m.sum())], 1)
        w = np.array([0.5, 0.4, 0.1]) if b else np.array([0.0, 0.9, 0.1])
        for _ in range(rounds):
            e = parts * w
            e *= (n[m] / e.sum(1))[:, None]
            w = e.sum(0) + np.array([0.5 if b else 0.0, 0.5, 0.5])
            w /= w.sum()
        weights[b] = last = w
    return weights


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10) for every row."""
    buckets = max(4, corpus_bytes(docs) // BUCKET_BYTES)
    chunks = stage_chunks(docs, "lm", max(8, buckets), most=CHUNK_BYTES)
    answers = stage(_answers(chunks.mapInArrow(_ask(buckets), BLOB_SCHEMA), buckets), "lm")
    stats = [unpack_arrays(bytes(r["blob"]))[0] for r in answers.where(F.col("chunk") == STATS).collect()]  # three numbers a bucket
    total, distinct, kept_total = (int(x) for x in np.sum(stats, axis=0)) if stats else (0, 0, 0)
    answers = answers.where(F.col("chunk") != STATS)
    uniform = 1.0 / (distinct + 1)

    def histogram(c: int, chunk: Chunk, right: pa.Table) -> Iterator[pa.RecordBatch]:
        t = Tokens(chunk)
        _, words, _, pairs = _counts(t, right, buckets)
        m = t.fold == DELETED
        cv = words[t.v[m]]
        r2 = pairs[t.p[m]] / np.maximum(cv, 1) / uniform
        r1 = words[t.w[m]] / max(kept_total, 1) / uniform
        code, n = np.unique((_context(cv) * BINS + _bin(r2)) * BINS + _bin(r1), return_counts=True)
        yield pa.RecordBatch.from_pydict({"code": pa.array(code, pa.int64()), "n": pa.array(n, pa.int64())})

    hist = with_answers(chunks, answers, histogram, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    weights = fit(sorted((r["code"], r["n"]) for r in hist.collect()))  # at most CONTEXTS * BINS * BINS rows, few in use

    def score(c: int, chunk: Chunk, right: pa.Table) -> Iterator[pa.RecordBatch]:
        t = Tokens(chunk)
        words, _, pairs, _ = _counts(t, right, buckets)
        cw, cv = words[t.w], words[t.v]
        w = weights[_context(cv)]
        p = w[:, 0] * pairs[t.p] / np.maximum(cv, 1) + w[:, 1] * cw / max(total, 1) + w[:, 2] * uniform
        base = np.log10((cw + 0.5) / (total + 0.5 * (distinct + 1)))
        f = folds(chunk.ids)
        yield pa.RecordBatch.from_pydict({
            "doc_id": chunk.doc_ids(), "held_out": pa.array(f == HELD), "n_tokens": pa.array(t.counts),
            "n_known": pa.array(np.add.reduceat((cw > 0).astype(np.int64), t.starts)), "train_tokens": pa.array(np.full(len(f), total)),
            "base_score": pa.array(np.add.reduceat(base, t.starts)), "score": pa.array(np.add.reduceat(np.log10(p), t.starts)),
        })

    return with_answers(chunks, answers, score, RESULT)
