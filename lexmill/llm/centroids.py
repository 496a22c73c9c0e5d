"""Operator 13: centroid clustering by filtering kd-trees, exact in whole numbers.

Vectors become whole numbers, floor(256 * x), and are dealt to blocks of at most ``BLOCK`` rows, each with a kd-tree
whose nodes hold a box, a count, the components' sums and the sum of squares. Blocks are written once to the shared
folder. A round walks every tree from its root with the centroids that may still be nearest to a point of the node:
the one nearest to the box's middle is held against each other, and the other goes if it is farther even at the
corner that suits it best (strictly: an equal corner keeps it). A node with one centroid left is assigned whole, by its
sums; a leaf with several compares its points. Only counts and sums of each centroid leave a task, added up by Spark,
and the driver holds the centroids alone.

Numbers are exact at any size: doubles while every product stays under 2^53, then 64-bit, then Python integers; sums
leave tasks in parts of 40 bits. A distance or inertia over the largest long is given as the largest long (it takes
components beyond 2^28).

A vector that is null, has another length, or holds a null or non-finite component takes no part and gives no row. A
row without vec_id is assigned like any other but is never a first centroid. Rows that repeat a vec_id are rows of
their own; as they share a hash, the lesser vector is a centroid before the greater. Equal distances go to the smaller
number; an empty centroid stays. Fewer vectors than centroids give as many centroids as vectors with an id; an empty
table gives an empty result. Other columns take no part, whatever they are called; texts play no part.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pack_arrays, stage, unpack_arrays

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
BLOCK, LEAF = 8192, 32
LONG_MAX = (1 << 63) - 1
#: Bits of a sum that travel in one long.
LIMB = 40
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def kept_vectors(df: DataFrame, vec: str = "embedding", dims: int = DIMS) -> DataFrame:
    """vec_id and e, the vectors that take part, as doubles."""
    own = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(f"`{vec}`").cast("array<double>").alias("e"))
    return own.where((F.size("e") == dims) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _whole(x: float, scale: int) -> int:
    """floor(scale * x) of a finite double, also where the product passes the doubles."""
    y = np.floor(x * scale)
    return int(y) if np.isfinite(y) else int(x) * scale


class Tree:
    """A kd-tree over a block: points in tree order, and for each node its range, children (-1: a leaf), box and sums."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, points: np.ndarray, shape: np.ndarray, lo: np.ndarray, hi: np.ndarray, sums: np.ndarray, squares: np.ndarray):
        self.ids, self.null, self.points, self.shape = ids, null, points, shape
        self.lo, self.hi, self.sums, self.squares = lo, hi, sums, squares

    @classmethod
    def build(cls, ids: np.ndarray, null: np.ndarray, x: np.ndarray) -> Tree:
        """x holds whole numbers: doubles while a block's sum of squares fits in a long, else Python integers."""
        n, d = x.shape
        order = np.arange(n)
        shape: list[list[int]] = []
        lo, hi, sums, squares = [], [], [], []
        todo = [(0, n, -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            if parent >= 0:
                shape[parent][2 + side] = len(shape)
            pts = x[order[a:b]]
            least, most = pts.min(0), pts.max(0)
            at = len(shape)
            shape.append([a, b, -1, -1])
            lo.append(least)
            hi.append(most)
            sums.append(pts.sum(0))
            squares.append(int((pts * pts).sum(1).astype(object).sum()))
            spread = most - least
            if b - a > LEAF and (spread > 0).any():
                half = (b - a) // 2
                cut = np.argpartition(pts[:, int(np.argmax(spread))], half)
                order[a:b] = order[a:b][cut]
                todo += [(a, a + half, at, 0), (a + half, b, at, 1)]
        return cls(ids[order], null[order], x[order], np.array(shape, np.int64), np.array(lo), np.array(hi), np.array(sums), np.array(squares, object))

    def pack(self) -> bytes:
        """As bytes: in the narrowest numbers that hold the points, or as decimal text for Python integers."""
        if self.points.dtype == object:
            big = [json.dumps([[int(v) for v in row] for row in m]).encode() for m in (self.points, self.lo, self.hi, self.sums)]
            big.append(json.dumps([int(v) for v in self.squares]).encode())
            return pack_arrays([self.ids, self.null.astype("u1"), self.shape.ravel(), *(np.frombuffer(b, "u1") for b in big)])
        top = float(np.abs(self.points).max())
        kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
        plain = [m.astype(kind).ravel() for m in (self.points, self.lo, self.hi)]
        return pack_arrays([self.ids, self.null.astype("u1"), self.shape.ravel(), *plain, self.sums.astype("<i8").ravel(), self.squares.astype("<i8")])

    @classmethod
    def unpack(cls, blob: bytes, dims: int) -> Tree:
        ids, null, shape, *rest = unpack_arrays(blob)
        if rest[0].dtype == np.uint8:
            mats = [np.array(json.loads(r.tobytes()), object) for r in rest]
        else:
            mats = [m.reshape(-1, dims) for m in rest[:4]] + [rest[4]]
        return cls(ids, null.astype(bool), mats[0], shape.reshape(-1, 4), *mats[1:])


def _numbers(tree: Tree, top: int) -> type:
    """What to count in: every product of a walk over components up to top stays exact in it."""
    room = top * top * tree.points.shape[1]
    if tree.points.dtype == object or room >= 1 << 59:
        return object
    return np.float64 if room < 1 << 50 else np.int64


def walk(tree: Tree, centroids: list[list[int]]) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray, np.ndarray, type]:
    """Whole nodes by centroid, and for the points of the leaves left: their places, centroids and squared distances."""
    top = max([int(abs(v)) for m in (tree.lo, tree.hi) for v in (m.min(), m.max())] + [abs(v) for z in centroids for v in z])
    kind = _numbers(tree, top)
    z = np.array(centroids, object).astype(kind)
    zz = (z * z).sum(1)
    lo, hi = tree.lo.astype(kind), tree.hi.astype(kind)
    nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(z)), bool)
    whole: list[tuple[int, np.ndarray]] = []
    places, masks = [], []
    while len(nodes):
        a, b = lo[nodes], hi[nodes]
        middle = _least(zz - (a + b) @ z.T, open_)
        for star in np.unique(middle).tolist():
            rows = np.flatnonzero(middle == star)
            u = z - z[star]
            corner = b[rows] @ np.maximum(u, 0).T + a[rows] @ np.minimum(u, 0).T
            open_[rows] &= ~((zz - zz[star] - 2 * corner) > 0)
        alone = open_.sum(1) == 1
        for star in np.unique(middle[alone]).tolist():
            whole.append((star, nodes[alone & (middle == star)]))
        leaf = ~alone & (tree.shape[nodes, 2] < 0)
        for node, mask in zip(nodes[leaf].tolist(), open_[leaf], strict=True):
            p = np.arange(tree.shape[node, 0], tree.shape[node, 1])
            places.append(p)
            masks.append(np.broadcast_to(mask, (len(p), len(z))))
        on = ~alone & ~leaf
        nodes, open_ = tree.shape[nodes[on], 2:].T.reshape(-1), np.concatenate([open_[on], open_[on]])
    if not places:
        return whole, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind), kind
    at = np.concatenate(places)
    pts = tree.points[at].astype(kind)
    score = zz - 2 * (pts @ z.T)
    own = _least(score, np.concatenate(masks))
    return whole, at, own, (pts * pts).sum(1) + score[np.arange(len(at)), own], kind


def _least(score: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """For each row the first of its open columns with the least score."""
    if score.dtype == object:
        return np.array([min(np.flatnonzero(o).tolist(), key=lambda j, s=s: (s[j], j)) for s, o in zip(score, open_, strict=True)], np.int64)
    return np.where(open_, score, np.inf if score.dtype == np.float64 else LONG_MAX).argmin(1)


def totals(tree: Tree, centroids: list[list[int]]) -> np.ndarray:
    """For each centroid: the sums of its vectors' components, their sum of squares and their count, as Python integers."""
    dims = tree.points.shape[1]
    out = np.zeros((len(centroids), dims + 2), object)
    whole, at, own, _, kind = walk(tree, centroids)
    for star, nodes in whole:
        out[star, :dims] += tree.sums[nodes].astype(object).sum(0)
        out[star, dims] += int(tree.squares[nodes].astype(object).sum())
        out[star, dims + 1] += int((tree.shape[nodes, 1] - tree.shape[nodes, 0]).sum())
    for star in np.unique(own).tolist():
        pts = tree.points[at[own == star]].astype(object if kind is object else np.int64)
        out[star, :dims] += pts.sum(0).astype(object)
        out[star, dims] += int((pts * pts).sum())
        out[star, dims + 1] += len(pts)
    return out


def assign(tree: Tree, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """Each point's centroid and squared distance."""
    whole, at, own, far, kind = walk(tree, centroids)
    cluster, dist = np.zeros(len(tree.ids), np.int64), np.zeros(len(tree.ids), object)
    cluster[at], dist[at] = own, far.astype(object if kind is object else np.int64)
    for star, nodes in whole:
        centre = np.array(centroids[star], object).astype(kind)
        for a, b in tree.shape[nodes, :2].tolist():
            gap = tree.points[a:b].astype(kind) - centre
            cluster[a:b], dist[a:b] = star, (gap * gap).sum(1).astype(object if kind is object else np.int64)
    return cluster, [min(int(x), LONG_MAX) for x in dist.tolist()]


def stage_trees(kept: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """One row for each block of at most ``BLOCK`` vectors: its tree, in the shared folder."""

    def tree(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        ids = t.column(0)
        x = pa.concat_arrays(t.column(1).chunks).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        y = np.floor(x * scale)
        if not float(np.abs(y).max()) ** 2 * dims * BLOCK < 1 << 62:
            y = np.array([[_whole(v, scale) for v in row] for row in x.tolist()], object)
        blob = Tree.build(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), y).pack()
        return pa.RecordBatch.from_pydict({"blob": pa.array([blob], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        held = 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                piece = b.slice(at, BLOCK - held)
                parts.append(piece)
                held += piece.num_rows
                at += piece.num_rows
                if held == BLOCK:
                    yield tree(parts)
                    parts, held = [], 0
        if held:
            yield tree(parts)

    return stage(kept.mapInArrow(run, "blob binary"), "centroids", kept=True)


def first_centroids(kept: DataFrame, k: int = K, seed: int = SEED, scale: int = SCALE) -> list[list[int]]:
    """The k vectors with the smallest hashes of seed and vec_id, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.where(F.col("vec_id").isNotNull()).select(key.alias("key"), "e").orderBy("key", "e").limit(k).collect()
    return [[_whole(v, scale) for v in r.e] for r in rows]


def _sums(trees: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """``totals`` over all blocks: one row for each centroid and component leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), dims + 2), object)
        for b in batches:
            for blob in b.column(0):
                total += totals(Tree.unpack(blob.as_py(), dims), centroids)
        rows = []
        for c, values in enumerate(total.tolist()):
            for j, v in enumerate(values):
                rest, limb, sign = abs(v), 0, -1 if v < 0 else 1
                while rest:
                    rows.append((c, j, limb, sign * (rest & ((1 << LIMB) - 1))))
                    rest, limb = rest >> LIMB, limb + 1
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        kinds = {"cluster": pa.int32(), "part": pa.int32(), "limb": pa.int32(), "value": pa.int64()}
        yield pa.RecordBatch.from_pydict({n: pa.array(col, t) for (n, t), col in zip(kinds.items(), cols, strict=True)})

    out = [[0] * (dims + 2) for _ in centroids]
    parts = trees.mapInArrow(run, "cluster int, part int, limb int, value long")
    # As many rows as centroids, components and parts of a number, whatever the table holds.
    for r in parts.groupBy("cluster", "part", "limb").agg(F.sum("value").alias("value")).collect():
        out[r["cluster"]][r["part"]] += r["value"] << (LIMB * r["limb"])
    return out


def cluster(df: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, vec: str = "embedding") -> DataFrame:
    """One row for each vector that takes part: its centroid, squared distance, the sums of distances and the centroid's hash."""
    spark = df.sparkSession
    kept = kept_vectors(df, vec, dims)
    centroids = first_centroids(kept, k, seed, scale)
    if not centroids:
        return spark.createDataFrame([], OUT)
    trees = stage_trees(kept, dims, scale)
    for _ in range(rounds):
        for c, (*sums, _squares, n) in enumerate(_sums(trees, centroids, dims)):
            if n:
                centroids[c] = [s // n for s in sums]
    inertia = [
        squares - 2 * sum(a * b for a, b in zip(z, sums, strict=True)) + n * sum(a * a for a in z)
        for z, (*sums, squares, n) in zip(centroids, _sums(trees, centroids, dims), strict=True)
    ]
    everything = min(sum(inertia), LONG_MAX)
    own = pa.array([min(x, LONG_MAX) for x in inertia], pa.int64())
    names = pa.array([hashlib.sha256(",".join(map(str, z)).encode()).hexdigest() for z in centroids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                tree = Tree.unpack(blob.as_py(), dims)
                found, dist = assign(tree, centroids)
                at = pa.array(found)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": pa.array(tree.ids, pa.int64(), mask=tree.null), "cluster": at.cast(pa.int32()), "distance": pa.array(dist, pa.int64()),
                    "cluster_inertia": own.take(at), "inertia": pa.array([everything] * len(found), pa.int64()), "centroid_sha256": names.take(at),
                })

    return trees.mapInArrow(run, OUT)
