"""Operator 10: pack documents into fixed token windows by concatenating and cutting.

Pass 1 tokenizes each partition once and stores ids with a running total inside the partition. The partitions'
totals (one number each) are prefix-summed to global offsets. Pass 2 cuts each document at multiples of the window
length and writes one boundary record per piece; it needs no shuffle. Nothing is padded but the last sequence.

Null texts count as empty: the closing id alone. A very long text is one row of ids and as many pieces as it fills. Ties can't arise (each id has one place). An empty table gives an
empty result. Repeated doc_ids are packed once per row. Ids come from the vocabulary file given, encoded by
tiktoken's byte-pair merge with the same ranks and pattern; tests hold them against the tokenizers library. Columns other
than doc_id and text take no part, whatever they are called.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_docs, stage

WINDOW = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[Callable[[str], list[int]], str]:
    """text -> ids for a byte-level BPE file whose ids follow the merges' order, and the type code that holds any id.
    Added tokens of the file are cut out of the text before the merges, as its own reader does."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    to_byte = _byte_of_char()
    ranks = {bytes(to_byte[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in added}
    plain = tiktoken.Encoding("vocab", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    code = "H" if max([*ranks.values(), *added.values(), END_ID]) < 1 << 16 else "I"
    if not added:
        return plain, code
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=lambda x: (-len(x), x)))) + ")")

    def encode(text: str) -> list[int]:
        parts = cut.split(text)
        if len(parts) == 1:
            return plain(text)
        return [i for k, p in enumerate(parts) for i in ([added[p]] if k % 2 else plain(p))]

    return encode, code


def tokenized(docs: DataFrame, vocab_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """part, before (tokens of the partition before this document), doc_id, n, ids (unsigned, little-endian, of 16 bits if the vocabulary allows, else 32)."""
    path = vocab_path or default_vocab()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        encode, code = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                piece = b.slice(at, 512)
                before, n, ids = [], [], []
                for t in piece.column(1).to_pylist():
                    x = array(code, encode(t)) if t else array(code)
                    x.append(end_id)
                    before.append(total)
                    n.append(len(x))
                    ids.append(x.tobytes())
                    total += len(x)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part] * len(n), pa.int32()), "before": pa.array(before, pa.int64()),
                    "doc_id": piece.column(0).cast(pa.int64()), "n": pa.array(n, pa.int64()), "ids": pa.array(ids, pa.binary()),
                })

    return plain_docs(docs).mapInArrow(run, "part int, before long, doc_id long, n long, ids binary")


def pack(docs: DataFrame, window: int = WINDOW, vocab_path: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: its document, where it starts there, its length and CRC-32, its sequence and offset."""
    staged = stage(tokenized(docs, vocab_path, end_id), "packing", kept=True)
    width = array(encoder(vocab_path or default_vocab())[1]).itemsize
    # One row per partition of the first pass: as many numbers as tasks, whatever the corpus holds.
    totals = sorted((r["part"], r["n"]) for r in staged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, at = {}, 0
    for part, n in totals:
        base[part] = at
        at += n

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            kept: list[bytes] = []
            for part, before, doc, n, ids in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                wide = np.frombuffer(ids, f"<u{width}").astype("<u4")
                first, s = base[part] + before, 0
                while s < n:
                    g = first + s
                    length = min(n - s, window - g % window)
                    piece = wide[s : s + length].tobytes()
                    out.append((doc, s, length, zlib.crc32(piece), n, g // window, g % window))
                    if with_ids:
                        kept.append(piece)
                    s += length
            names = [x.split()[0] for x in PIECES.split(", ")]
            cols = zip(*out, strict=True) if out else [[] for _ in names]
            data = {k: pa.array(v, pa.int64()) for k, v in zip(names, cols, strict=True)}
            yield pa.RecordBatch.from_pydict(data | ({"ids": pa.array(kept, pa.binary())} if with_ids else {}))

    return staged.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))
