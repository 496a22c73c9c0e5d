"""Shared pieces of the corpus operators: durable staging, text chunks, word hashes, window hashes.

Chunks. Several operators must see the same block of documents more than once (send questions about its
contents to hash buckets, get answers back, act on them). ``stage_chunks`` packs documents into rows of about
``CHUNK_BYTES`` of text, compressed, in a table bucketed by chunk id, so later passes join answers to a chunk
without shuffling the text. Questions and answers travel as packed numpy blobs: one row per (chunk, bucket).
"""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of text that one chunk holds (a longer document is a chunk of its own).
CHUNK_BYTES = 4 << 20

U = np.uint64
CHUNK_SCHEMA = "chunk long, ids binary, lens binary, body binary, rest binary"
BLOB_SCHEMA = "chunk long, bucket int, blob binary"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session that names none gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: What staging has written, for each ``scratch`` that is open.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the staged folders and tables written inside it at its end; their readers must have finished by then."""
    mine: list[str] = []
    _SCRATCH.append(mine)
    try:
        yield
    finally:
        _SCRATCH.pop()
        drop(spark, mine)


def drop(spark: SparkSession, names: list[str]) -> None:
    for name in names:
        if "/" in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        else:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def _written(name: str) -> str:
    if _SCRATCH:
        _SCRATCH[-1].append(name)
    return name


def stage_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it again: cuts lineage and survives lost executors. Also the path."""
    path = f"{shared_dir(df.sparkSession)}/lexmill-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """``stage_at`` without the path; ``kept`` tables outlive the ``scratch`` around them."""
    found, path = stage_at(df, name)
    if not kept:
        _written(path)
    return found


def corpus_bytes(docs: DataFrame, col: str = "text") -> int:
    """UTF-8 bytes of all texts: sizes the number of buckets to the input."""
    return int(docs.agg(F.sum(F.octet_length(col)).alias("n")).first()["n"] or 0)


def plain_docs(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns of the caller can't clash with ours."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


#: Stands for a null doc_id inside chunks: it sorts before all others.
NULL_ID = -(1 << 63)


def text_batches(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, list[bytes | None], pa.Table]]:
    """Regroup Arrow batches (doc_id, text, any others) to about ``most`` bytes of text: ids, texts as UTF-8, other columns."""
    parts: list[pa.RecordBatch] = []
    size = 0

    def out() -> tuple[np.ndarray, list[bytes | None], pa.Table]:
        t = pa.Table.from_batches(parts)
        ids = t.column(0).fill_null(NULL_ID).to_numpy()
        return ids, t.column(1).cast(pa.binary()).to_pylist(), t.drop_columns([t.column_names[0], t.column_names[1]])

    for b in batches:
        lens = pa.compute.fill_null(pa.compute.binary_length(b.column(1).cast(pa.binary())), 0).to_numpy(zero_copy_only=False).tolist()
        first = 0
        for i, n in enumerate(lens):
            size += n + 16
            if size >= most:
                parts.append(b.slice(first, i + 1 - first))
                yield out()
                parts, size, first = [], 0, i + 1
        if first < b.num_rows:
            parts.append(b.slice(first))
    if parts:
        yield out()


def stage_chunks(docs: DataFrame, name: str, buckets: int, keep: bool = False, most: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of docs, bucketed by chunk id. A null text has length -1. With keep, the other columns
    of docs ride along, whatever they are called."""
    spark = docs.sparkSession
    source = plain_docs(docs)
    if keep:
        rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        z = zstandard.ZstdCompressor(level=1)
        for ids, texts, rest in text_batches(batches, most):
            lens = np.array([-1 if t is None else len(t) for t in texts], np.int64)
            side = b""
            if keep:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema) as w:
                    w.write_table(rest)
                side = z.compress(sink.getvalue().to_pybytes())
            row = {"chunk": pa.array([(part << 20) | k], pa.int64())}
            blobs = {"ids": ids.tobytes(), "lens": lens.tobytes(), "body": z.compress(b"".join(t for t in texts if t)), "rest": side}
            yield pa.RecordBatch.from_pydict(row | {n: pa.array([v], pa.binary()) for n, v in blobs.items()})
            k += 1

    # A bucketed table, its files in the shared folder: the warehouse may lie on the driver's machine alone.
    table = f"lexmill_{name}_{uuid.uuid4().hex}"
    path = _written(f"{shared_dir(spark)}/{table}")
    _written(table)
    (source.mapInArrow(pack, CHUNK_SCHEMA).write.option("compression", "none").option("path", path)
     .bucketBy(buckets, "chunk").format("parquet").saveAsTable(table))
    return spark.table(table)


class Chunk:
    """One unpacked chunk row: ids, lens (0 for null), the texts' bytes on end, and where each text starts."""

    def __init__(self, ids: bytes, lens: bytes, body: bytes, rest: bytes = b""):
        self.ids = np.frombuffer(ids, np.int64)
        self.null = np.frombuffer(lens, np.int64) < 0
        self.lens = np.maximum(np.frombuffer(lens, np.int64), 0)
        self.body = zstandard.ZstdDecompressor().decompress(body)
        self.ends = np.cumsum(self.lens)
        self.starts = self.ends - self.lens
        self._rest = rest

    def texts(self) -> list[bytes]:
        return [self.body[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]

    def doc_ids(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.ids == NULL_ID)

    def rest(self) -> pa.Table:
        return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(self._rest)).read_all()


def own_columns(chunk: Chunk, spec: StructType, text: pa.Array | None = None) -> list[pa.Array]:
    """The columns of spec, as ``stage_chunks`` with keep has stored them; text replaces the texts."""
    rest = chunk.rest().combine_chunks()
    own, i = [], 0
    for f in spec:
        if f.name == "doc_id":
            own.append(chunk.doc_ids())
        elif f.name == "text":
            own.append(text if text is not None else pa.array([None if n else t for t, n in zip(chunk.texts(), chunk.null.tolist(), strict=True)], pa.binary()).cast(pa.string()))
        else:
            own.append(rest.column(i).combine_chunks() if rest.num_rows else pa.nulls(0, rest.schema.field(i).type))
            i += 1
    return own


def own_schema(spec: StructType, more: int = 0) -> StructType:
    """Their types under plain names, and ``more`` longs."""
    kinds = [T.LongType() if f.name == "doc_id" else T.StringType() if f.name == "text" else f.dataType for f in spec] + [T.LongType()] * more
    return T.StructType([T.StructField(f"c{j}", k) for j, k in enumerate(kinds)])


def chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk]]:
    for b in batches:
        c = [b.column(n) for n in ("chunk", "ids", "lens", "body", "rest")]
        for i in range(b.num_rows):
            yield c[0][i].as_py(), Chunk(*(x[i].as_py() for x in c[1:]))


def pack_arrays(arrays: list[np.ndarray]) -> bytes:
    """Arrays as one blob: each with its dtype and length, compressed where that helps."""
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        small = zstandard.ZstdCompressor(level=1).compress(raw) if len(raw) > 64 else raw
        use = len(small) < 0.9 * len(raw)
        data = small if use else raw
        parts += [struct.pack("<2sBI", a.dtype.str[1:3].encode(), use, len(data)), data]
    return b"".join(parts)


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, packed, n = struct.unpack_from("<2sBI", blob, at)
        at += 7
        raw = blob[at : at + n]
        out.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw) if packed else raw, "<" + kind.decode()))
        at += n
    return out


def narrow(a: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of each 64-bit number."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).reshape(-1)


def widen(b: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = b.view(np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


def pack_sorted(a: np.ndarray, width: int) -> np.ndarray:
    """Sorted numbers under 2**(8*width) as differences, byte by byte of all of them: the high bytes are mostly zero."""
    return np.ascontiguousarray(narrow(np.diff(a, prepend=a[:1] * U(0)), width).reshape(-1, width).T).reshape(-1)


def unpack_sorted(b: np.ndarray, width: int) -> np.ndarray:
    return np.cumsum(widen(np.ascontiguousarray(b.view(np.uint8).reshape(width, -1).T).reshape(-1), width), dtype=U)


def to48(a: np.ndarray) -> np.ndarray:
    return narrow(a, 6)


def from48(b: np.ndarray) -> np.ndarray:
    return widen(b, 6)


def blob_batch(chunk: list[int], bucket: list[int], blob: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"chunk": pa.array(chunk, pa.int64()), "bucket": pa.array(bucket, pa.int32()), "blob": pa.array(blob, pa.binary())})


def answer_per_bucket(asked: DataFrame, answer: Callable[[list[int], list[bytes]], list[bytes]]) -> DataFrame:
    """Bring a bucket's blobs together and give each chunk its answer. Hashes deal keys evenly and each chunk has
    sent each key once, so a bucket's size follows the number of buckets, not any key's frequency."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        chunks = t.column("chunk").to_pylist()
        out = answer(chunks, t.column("blob").to_pylist())
        return pa.Table.from_batches([blob_batch(chunks, [key[0].as_py()] * len(chunks), out)])

    return asked.groupBy("bucket").applyInArrow(run, BLOB_SCHEMA)


def with_answers(chunks: DataFrame, answers: DataFrame, fn: Callable[[int, Chunk, pa.Table], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Each chunk with all rows sent back to it; only the answers are shuffled (the chunk table is bucketed)."""
    empty = (_arrow_schema(schema) if isinstance(schema, str) else to_arrow_schema(schema)).empty_table()

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [r for c, chunk in chunk_rows(left.to_batches()) for r in fn(c, chunk, right)]
        return pa.Table.from_batches(out) if out else empty

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def _arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in ddl.split(","))])


class WordHashes(dict):
    """word -> XXH3-64; forgets everything when it has MOST words, so a worker's memory stays bounded."""

    MOST = 400_000

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


#: One per Python worker, kept from task to task.
WORDS = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), U, len(words))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit mix of two arrays of hashes."""
    x = a * U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    x += b
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


_B = 0x9E3779B97F4A7C15 | 1
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least the first n + 1 powers of an odd number and of its inverse, modulo 2**64. The longest ones asked for are kept."""
    if not _POWERS or len(_POWERS[0][0]) <= n:
        inverse = pow(_B, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS[:] = [tuple(np.cumprod(np.concatenate([np.ones(1, U), np.full(n, b, U)])) for b in (_B, inverse))]
    return _POWERS[0]


#: A random number for each byte, and bytes that are hashed together.
BYTES = np.random.default_rng(4).integers(1, 1 << 63, 256).astype(U)
SLICE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes_of(body: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of documents that lie on end in body, and where each word begins: differences of running sums
    of the bytes' random numbers by powers of an odd base, mixed with the word's length."""
    raw = np.frombuffer(body, np.uint8)
    word = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[starts] = True
    edge[ends] = True
    # A word begins after a space or a document's edge, and ends before one.
    first = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
    last = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    out = np.empty(len(first), U)
    at = 0
    while at < len(first):  # as many words as begin in a slice
        to = max(at + 1, int(np.searchsorted(last, first[at] + SLICE, side="right")))
        base, size = int(first[at]), int(last[to - 1] - first[at])
        up, down = powers(max(SLICE, size))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(BYTES[raw[base : base + size]] * up[:size])])
        lo, hi = first[at:to] - base, last[at:to] - base
        out[at:to] = mix((sums[hi] - sums[lo]) * down[lo], (hi - lo).astype(U))
        at = to
    return out, first


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive symbols of h, by doubling and one overlapping step."""
    m = 1
    while m * 2 <= k and len(h):
        h = mix(h[:-m], h[m:]) if len(h) > m else h[:0]
        m *= 2
    if m < k:
        d = k - m
        h = mix(h[:-d], h[d:]) if len(h) > d else h[:0]
    return h


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    m = 1
    while m * 2 <= w:
        v = np.minimum(v[:-m], v[m:])
        m *= 2
    return np.minimum(v[: -(w - m)], v[w - m :]) if m < w else v


def words_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; bytes.split() cuts at exactly these six characters."""
    return (text or b"").split()
