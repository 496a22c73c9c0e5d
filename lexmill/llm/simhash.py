"""Operator 7: SimHash near-duplicates by tiled exact comparison.

Texts become 64-bit fingerprints of their word shingles. Distinct fingerprints are dealt to tiles by the population
counts of their four 16-bit quarters; two fingerprints within the radius have counts whose differences sum to the
radius at most, so only such tile pairs meet, and the rest are skipped unread. A pair of tiles is compared exactly
with numpy's exclusive-or and bit counts, in blocks, and yields a star for each group that it links (never all
pairs). Components of fingerprints then follow by minimum labels and pointer jumping over staged tables.

Null or blank texts have fingerprint zero and link like any other. Rows that repeat a text share a component; rows that
repeat a doc_id are told apart. A row without doc_id links like any other and gets its component's smallest doc_id (null
if there is none). Very long texts are hashed whole, in slices. Empty tables give empty results. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Chunk, U, chunk_rows, corpus_bytes, own_columns, own_schema, plain_docs, stage, stage_chunks, with_answers

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints that one block of a tile holds.
BLOCK = 2048
#: Text of one bucket of the chunk table.
BUCKET_BYTES = 16 << 20


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(joined, seed)], "<u8")
    else:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens + 1) - 1
        starts = (ends - lens)[: 1 - shingle].tolist()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), "<u8", len(starts))
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # a very long text in slices
        total += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0).cast(pa.int64()), "fp": pa.array(np.array(fps, U).view(np.int64), pa.int64())})

    return plain_docs(docs).mapInArrow(run, "doc_id long, fp long")


def _offsets(radius: int, quarters: int = 4) -> list[tuple[int, ...]]:
    """Differences of population counts that fingerprints within the radius can have; one of each opposite two."""
    every = itertools.product(range(-radius, radius + 1), repeat=quarters)
    return [d for d in every if sum(map(abs, d)) <= radius and d >= (0,) * quarters]


def _stars(fa: np.ndarray, fb: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the two blocks as stars: each linked fingerprint with the smallest of its group."""
    pairs = []
    for at in range(0, len(fa), 512):
        near = np.bitwise_count(fa[at : at + 512, None] ^ fb[None, :]) <= radius
        r, c = np.nonzero(near)
        pairs.append((fa[at : at + 512][r].view(np.int64), fb[c].view(np.int64)))
    u, v = (np.concatenate(x) for x in zip(*pairs, strict=True))
    u, v = u[u != v], v[u != v]
    if not len(u):
        return u, v
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) whose components are those of all fingerprint pairs within the radius. prints: fp (distinct)."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("int") for i in range(4)]
    # A tile's fingerprints in blocks of bounded size; the block number is dealt by hash.
    n = prints.count()
    salt = max(1, n // (BLOCK * 160))
    tiles = prints.select(F.array(*quarter).alias("tile"), F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(salt)).alias("salt"), "fp")

    def block(key: tuple, t: pa.Table) -> pa.Table:
        fp = t.column("fp").to_numpy()
        cuts = range(0, len(fp), BLOCK)
        return pa.table({
            "tile": pa.array([key[0].as_py()] * len(cuts), pa.list_(pa.int32())), "salt": pa.array([(key[1].as_py() << 20) + j for j in range(len(cuts))], pa.int64()),
            "fps": pa.array([fp[c : c + BLOCK].tobytes() for c in cuts], pa.binary()),
        })

    blocks = stage(tiles.groupBy("tile", "salt").applyInArrow(block, "tile array<int>, salt long, fps binary"), "tiles")
    steps = F.array(*[F.array(*[F.lit(x) for x in d]) for d in _offsets(radius)])
    left = blocks.select(F.col("salt").alias("salt_a"), F.col("tile").alias("tile_a"), F.col("fps").alias("fps_a"), F.explode(steps).alias("step")).select(
        F.zip_with("tile_a", "step", lambda a, b: a + b).alias("tile"), (F.aggregate("step", F.lit(0), lambda s, x: s + F.abs(x)) == 0).alias("same"), "salt_a", "fps_a"
    )
    # There are at most 17 ** 4 tiles: a block's bytes go only where a tile is.
    there = F.broadcast(blocks.select("tile").distinct())
    met = left.join(there, "tile", "left_semi").join(blocks, "tile").where(~F.col("same") | (F.col("salt_a") <= F.col("salt"))).select("fps_a", "fps")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for fa, fb in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True):
                u, v = _stars(np.frombuffer(fa, U), np.frombuffer(fb, U), radius)
                us.append(u)
                vs.append(v)
            yield pa.RecordBatch.from_pydict({"u": pa.array(np.concatenate(us)), "v": pa.array(np.concatenate(vs))})

    return met.mapInArrow(compare, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of an edge. Each round a node hears its neighbours'
    labels, hands the least to its own label as well, and takes over its label's label, until nothing changes."""
    both = stage(edges.union(edges.select("v", "u")), "edges").toDF("u", "v")
    labels = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        heard = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("m"))
        told = stage(labels.join(heard, labels.node == heard.u).select("node", F.col("label").alias("old"), F.least("label", "m").alias("low")), "told")
        if told.where("low < old").limit(1).count() == 0:
            return labels
        handed = told.where("low < old").groupBy(F.col("old").alias("at")).agg(F.min("low").alias("given"))
        low = stage(told.join(handed, told.node == handed.at, "left").select("node", F.least("low", F.coalesce("given", "low")).alias("label")), "low")
        up = low.select(F.col("node").alias("at"), F.col("label").alias("over"))
        labels = stage(low.join(up, low.label == up.at).select("node", F.least("over", "label").alias("label")), "labels")


def groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, group): each distinct fingerprint of ``prints`` with the smallest one of its component."""
    nodes = stage(prints.select("fp").distinct(), "nodes")
    labels = components(links(nodes, radius))
    return nodes.join(labels, nodes.fp == labels.node, "left").select("fp", F.coalesce("label", "fp").alias("group"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs."""
    prints = stage(fingerprints(docs, shingle), "fingerprints")
    of_fp = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    found = stage(of_fp.join(groups(prints, radius), "fp"), "groups")
    ids = found.groupBy("group").agg(F.min("least").alias("component_id"))
    own = stage(found.join(ids, "group").select("fp", "rows", "component_id"), "components")
    # A fingerprint with over a thousandth of all rows, of which there are under a thousand, is joined by broadcast.
    many = max(1, prints.count() // HOT)
    hot, rest = F.broadcast(own.where(F.col("rows") > many).drop("rows")), own.where(F.col("rows") <= many).drop("rows")
    every = prints.join(hot, "fp").unionByName(prints.join(hot.select("fp"), "fp", "left_anti").join(rest, "fp"))
    return every.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A fingerprint is common if it has more than this part of all rows.
HOT = 1000
#: A chunk holds fewer rows than this power of two.
ROW_BITS = 18


def without_near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of each component of docs, all columns as they are: the one with the smallest doc_id, rows without
    doc_id last, among equals the first in the table. Texts are staged in chunks and not shuffled."""
    spec = docs.schema
    chunks = stage_chunks(docs, "simhash", max(8, corpus_bytes(docs) // BUCKET_BYTES), keep=True)

    def of_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, chunk in chunk_rows(batches):
            fps = np.array([fingerprint(t, shingle) for t in chunk.texts()], U).view(np.int64)
            yield pa.RecordBatch.from_pydict({"row": pa.array((c << ROW_BITS) + np.arange(len(fps)), pa.int64()), "doc_id": chunk.doc_ids(), "fp": pa.array(fps)})

    prints = stage(chunks.mapInArrow(of_chunk, "row long, doc_id long, fp long"), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = prints.groupBy("fp").agg(F.min(rank).alias("first")).join(groups(prints, radius), "fp").groupBy("group").agg(F.min("first").alias("first"))
    kept = first.select(F.shiftright("first.row", ROW_BITS).alias("chunk"), F.col("first.row").bitwiseAND((1 << ROW_BITS) - 1).alias("row"))

    def pick(c: int, chunk: Chunk, right: pa.Table) -> Iterator[pa.RecordBatch]:
        own = pa.RecordBatch.from_arrays(own_columns(chunk, spec), [f"c{i}" for i in range(len(spec))])
        yield own.take(pa.array(np.sort(right.column("row").to_numpy())))

    return with_answers(chunks, kept, pick, own_schema(spec)).toDF(*[f.name for f in spec])
