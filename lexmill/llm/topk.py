"""Operator 6: exact top-k inner products by dual-tree search over cover trees.

Vectors become whole numbers, floor(64 * x). All of them, queries and candidates alike, are dealt to cells round
pivots (the top of the tree, a bounded sample) and each cell to blocks of bounded size; a block holds a cover tree of
its vectors and one of its queries. A query block first searches its own cell, which gives each query a kth score.
Then a pair of blocks is met only if the bound from centres and covering radii,

    q.x <= cq.cx + |cq| rx + |cx| rq + rq rx,

reaches the worst kth score of the query group, and inside a pair the two trees are walked together with the same
test. Results of pairs are merged by query. Ties go to the smaller vec_id; bounds never cut an equal score.

Vectors that are null or hold null or non-finite components, and rows without vec_id, take no part. Shorter vectors
are read as if zeros followed. Rows that repeat a vec_id are rows of their own: each is a candidate of the others. An empty
table gives an empty result; other columns take no part, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

K = 20
SCALE = 64
EVERY = 20
#: Vectors for each pivot, about, and the most pivots.
PER_PIVOT, PIVOTS = 2048, 256
BLOCK = 4096
LEAF = 256
#: Query blocks that one task meets with a data block.
GROUP = 64
#: Below any score; its negative is a 64-bit number too.
LOWEST = -(1 << 62)


class CoverTree:
    """Nested covers of a matrix's rows. nodes: (centre, radius, children or None, rows). Children's centres are
    chosen farthest first until the parent's radius is halved, so they are apart and cover what the parent covers."""

    FAN = 16

    def __init__(self, x: np.ndarray):
        self.x = x
        self.top = float(np.abs(x).max()) if x.size else 0.0
        self.single = x.astype(np.float32) if self.top**2 * x.shape[1] < 1 << 24 else None
        self.nodes: list[tuple[np.ndarray, float, list[int] | None, np.ndarray]] = []
        self.root = self._build(np.arange(len(x)), 0) if len(x) else -1

    def _build(self, rows: np.ndarray, first: int) -> int:
        pts = self.x[rows]
        centre = pts[first]
        dist = np.sqrt(((pts - centre) ** 2).sum(1))
        radius = float(dist.max())
        children = None
        if len(rows) > LEAF and radius > 0:
            near, owner, heads = dist.copy(), np.zeros(len(rows), np.int64), [first]
            while len(heads) < self.FAN and near.max() > radius / 2:
                far = int(near.argmax())
                d = np.sqrt(((pts - pts[far]) ** 2).sum(1))
                owner[d < near] = len(heads)
                near = np.minimum(near, d)
                heads.append(far)
            children = []
            for c, head in enumerate(heads):
                mine = np.flatnonzero(owner == c)
                children.append(self._build(rows[mine], int(np.flatnonzero(mine == head)[0])))
        self.nodes.append((centre, radius, children, rows))
        return len(self.nodes) - 1


class Best:
    """The k best of each query so far: scores (highest first) and ids. What may be better waits until it is many."""

    WAIT = 40_000

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.score = np.full((n, k), LOWEST)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.worst = self.score[:, -1].copy()
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """score: rows x candidates."""
        r, c = np.nonzero(score >= self.worst[rows][:, None])
        if len(r):
            self.waiting.append((rows[r], score[r, c].astype(np.int64), ids[c]))
            self.size += len(r)
            if self.size >= self.WAIT or self.worst.min() == LOWEST:
                self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        rows, score, ids = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.size = [], 0
        some = np.unique(rows)
        r = np.concatenate([np.repeat(some, self.k), rows])
        s = np.concatenate([self.score[some].reshape(-1), score])
        i = np.concatenate([self.id[some].reshape(-1), ids])
        order = np.lexsort((i, -s, r))
        r, s, i = r[order], s[order], i[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < self.k
        self.score[r[keep], place[keep]], self.id[r[keep], place[keep]] = s[keep], i[keep]
        self.worst[some] = np.maximum(self.worst[some], self.score[some, -1])


def products(qt: CoverTree, rows_q: np.ndarray, xt: CoverTree, rows_x: np.ndarray) -> np.ndarray:
    """Exact whole-number products: in single or double precision where every sum stays exact, else in 64-bit integers."""
    most = qt.top * xt.top * xt.x.shape[1]
    if most < 1 << 24 and qt.single is not None and xt.single is not None:
        return qt.single[rows_q] @ xt.single[rows_x].T
    if most < 2.0**53:
        return qt.x[rows_q] @ xt.x[rows_x].T
    return qt.x[rows_q].astype(np.int64) @ xt.x[rows_x].astype(np.int64).T


def dual_search(qt: CoverTree, xt: CoverTree, q_keys: np.ndarray, x_keys: np.ndarray, x_ids: np.ndarray, best: Best) -> None:
    """Walk two trees together; a pair of nodes is cut if its bound is under the query node's worst kth score."""
    if qt.root < 0 or xt.root < 0:
        return
    stack = [(qt.root, xt.root)]
    while stack:
        a, b = stack.pop()
        cq, rq, kids_q, rows_q = qt.nodes[a]
        cx, rx, kids_x, rows_x = xt.nodes[b]
        bound = cq @ cx + np.sqrt(cq @ cq) * rx + np.sqrt(cx @ cx) * rq + rq * rx
        if bound + 1e-9 * abs(bound) + 1e-6 < best.worst[rows_q].min():
            continue
        if kids_q is None and kids_x is None:
            s = products(qt, rows_q, xt, rows_x)
            own = np.isin(q_keys[rows_q], x_keys[rows_x])
            if own.any():
                s = s.astype(np.float64) if s.dtype == np.float32 else s
                s[q_keys[rows_q][:, None] == x_keys[rows_x][None, :]] = 2 * LOWEST
            best.add(rows_q, s, x_ids[rows_x])
        elif kids_x is None or (kids_q is not None and len(rows_q) * 4 > len(rows_x)):
            stack += [(c, b) for c in kids_q]
        else:  # the most promising child last, so that it is walked first
            stack += [(a, c) for c in sorted(kids_x, key=lambda c: float(cq @ xt.nodes[c][0]))]


def whole_vectors(rows: DataFrame, scale: int = SCALE, every: int = EVERY) -> DataFrame:
    """key (of the row), vec_id, query, dim, v (whole numbers as 64-bit floats)."""
    vec = F.col("embedding").cast("array<double>")
    good = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("e")).where(
        F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            e = b.column(1)
            flat = np.floor(e.flatten().to_numpy(zero_copy_only=False) * scale)
            ends = np.cumsum([0, *pa.compute.list_value_length(e).to_pylist()])
            v = [flat[x:y].tobytes() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            key = (part << 33) + k + np.arange(b.num_rows)
            k += b.num_rows
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(key), "vec_id": b.column(0), "query": pa.array(b.column(0).to_numpy() % every == 0), "dim": pa.array(np.diff(ends), pa.int64()), "v": pa.array(v, pa.binary()),
            })

    return good.mapInArrow(run, "key long, vec_id long, query boolean, dim long, v binary")


def _matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(blobs), dim))
    for i, b in enumerate(blobs):
        v = np.frombuffer(b)
        out[i, : len(v)] = v
    return out


BLOCKS = "block long, cell int, n long, keys binary, ids binary, x binary, centre binary, radius double"


def _blocks(cells: DataFrame, dim: int) -> DataFrame:
    def pack(key: tuple, t: pa.Table) -> pa.Table:
        out = []
        for j, at in enumerate(range(0, t.num_rows, BLOCK)):
            p = t.slice(at, BLOCK)
            x = _matrix(p.column("v").to_pylist(), dim)
            centre = x.mean(0)
            out.append(((key[0].as_py() << 40) + (key[1].as_py() << 16) + j, key[0].as_py(), len(x), p.column("key").to_numpy().tobytes(), p.column("vec_id").to_numpy().tobytes(), x.tobytes(), centre.tobytes(), float(np.sqrt(((x - centre) ** 2).sum(1)).max())))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.float64()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in BLOCKS.split(", ")])

    return cells.groupBy("cell", "salt").applyInArrow(pack, BLOCKS)


HITS = "q_key long, query_id long, vec_id long, score long"


_TREES: dict[tuple[bytes, int], CoverTree] = {}


def _tree(x: bytes, dim: int) -> CoverTree:
    """The tree of a packed matrix; a task meets the same block again and again, so a few are kept, by content."""
    key = (xxhash.xxh3_128_digest(x), dim)
    if key not in _TREES:
        if len(_TREES) >= 48:
            _TREES.pop(next(iter(_TREES)))
        _TREES[key] = CoverTree(np.frombuffer(x).reshape(-1, dim))
    return _TREES[key]


def _meet(data: DataFrame, asks: DataFrame, keys: list[str], dim: int, k: int) -> DataFrame:
    """Each data block (keys, ids, x) with the query blocks (qkeys, qids, qx, worst or null) that share its keys."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for qk, qi, qx, worst in zip(*(right.column(n).to_pylist() for n in ("qkeys", "qids", "qx", "worst")), strict=True):
            qk, qi = np.frombuffer(qk, np.int64), np.frombuffer(qi, np.int64)
            best = Best(len(qk), k)
            if worst is not None:
                best.worst = np.frombuffer(worst, np.int64).copy()
            for xk, xi, x in zip(*(left.column(n).to_pylist() for n in ("keys", "ids", "x")), strict=True):
                dual_search(_tree(qx, dim), _tree(x, dim), qk, np.frombuffer(xk, np.int64), np.frombuffer(xi, np.int64), best)
            best.settle()
            q, c = np.nonzero(best.score > LOWEST)
            out.append((qk[q], qi[q], best.id[q, c], best.score[q, c]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["q_key", "query_id", "vec_id", "score"])

    asks = asks.select(*[F.col(c).alias(c) for c in (*keys, "qkeys", "qids", "qx", "worst")])  # both may come of one table
    return data.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(run, HITS)


def _rank(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_key").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query among all other rows."""
    spark = rows.sparkSession
    vecs = stage(whole_vectors(rows, scale, every), "vectors")
    shape = vecs.agg(F.max("dim").alias("dim"), F.count("*").alias("n")).first()
    dim, n = int(shape["dim"] or 0), int(shape["n"])
    if not n or not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Pivots: the rows with the least hashes among those drawn at a rate that leaves a few times PIVOTS.
    pivots_ = min(PIVOTS, n // PER_PIVOT + 1)
    drawn = vecs.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(min(1.0, 8 * pivots_ / n) * 1_000_000) + 1)
    drawn = drawn.orderBy(F.xxhash64("key", F.lit(5))).limit(pivots_).select("v").collect() or vecs.limit(1).select("v").collect()
    pivots = np.unique(_matrix([bytes(r["v"]) for r in drawn], dim), axis=0)

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v").to_pylist(), dim)
            near = ((pivots**2).sum(1)[None, :] - 2 * x @ pivots.T).argmin(1) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32())], [*b.schema.names, "cell"])

    celled = stage(vecs.mapInArrow(cell, "key long, vec_id long, query boolean, dim long, v binary, cell int"), "cells")
    parts = {r["cell"]: r["n"] // BLOCK + 1 for r in celled.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # PIVOTS rows at most
    by_cell = F.create_map(*[F.lit(int(x)) for kv in parts.items() for x in kv])
    celled = celled.withColumn("salt", F.pmod(F.xxhash64("key", F.lit(3)), by_cell[F.col("cell")]))
    data = stage(_blocks(celled, dim), "blocks")
    asks = stage(_blocks(celled.where("query"), dim), "queries").select(
        F.col("block").alias("qblock"), F.col("cell"), F.col("keys").alias("qkeys"), F.col("ids").alias("qids"), F.col("x").alias("qx"), F.col("centre").alias("qc"), F.col("radius").alias("qr")
    )
    # First each query block against the blocks of its own cell.
    parts_ = data.select("cell", F.col("block"), "keys", "ids", "x")
    own = parts_.select("cell", "block").join(asks, "cell").withColumn("worst", F.lit(None).cast("binary"))
    near = stage(_meet(parts_, own.select("block", "qkeys", "qids", "qx", "worst"), ["block"], dim, k), "near")
    kth = _rank(near, k).groupBy("q_key").agg(F.min("score").alias("s"), F.count("*").alias("c"))
    kth = stage(kth.select("q_key", F.when(F.col("c") == k, F.col("s")).otherwise(F.lit(LOWEST)).alias("s")), "kth")

    keys_of = asks.select("qblock", "qkeys").mapInArrow(_explode_keys, "qblock long, pos int, q_key long")
    worst = keys_of.join(kth, "q_key", "left").select("qblock", "pos", F.coalesce("s", F.lit(LOWEST)).alias("s"))
    worst = worst.groupBy("qblock").agg(F.min("s").alias("least"), F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("w"))  # BLOCK numbers a row
    asks = stage(asks.join(worst.select("qblock", "least", F.col("w.s").alias("w")), "qblock").mapInArrow(_pack_worst, "qblock long, cell int, qkeys binary, qids binary, qx binary, qc binary, qr double, least long, worst binary"), "asks")
    # Centres and radii of the query blocks: one row for BLOCK queries or a cell.
    heads = [(r["qblock"], r["cell"], np.frombuffer(bytes(r["qc"])), r["qr"], r["least"]) for r in asks.select("qblock", "cell", "qc", "qr", "least").collect()]
    if not heads:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    heads.sort(key=lambda h: h[0])
    q_block, q_cell, q_r, q_least = (np.array([h[i] for h in heads]) for i in (0, 1, 3, 4))
    q_c = np.stack([h[2] for h in heads])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks, hits, groups = [], [], []
            for block, c, centre, r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                x = np.frombuffer(centre)
                bound = q_c @ x + np.sqrt((q_c**2).sum(1)) * r + np.sqrt(x @ x) * q_r + q_r * r
                met = np.flatnonzero((q_cell != c) & (bound + 1e-9 * np.abs(bound) + 1e-6 >= q_least))
                blocks += [block] * len(met)
                hits += q_block[met].tolist()
                groups += (met // GROUP).tolist()
            yield pa.RecordBatch.from_pydict({"block": pa.array(blocks, pa.int64()), "part": pa.array(groups, pa.int64()), "qblock": pa.array(hits, pa.int64())})

    met = stage(data.select("block", "cell", "centre", "radius").mapInArrow(reach, "block long, part long, qblock long"), "met")
    sent = data.select("block", "keys", "ids", "x").join(met.select("block", "part").distinct(), "block")
    asked = met.join(asks.select("qblock", "qkeys", "qids", "qx", "worst"), "qblock")
    far = _meet(sent, asked, ["block", "part"], dim, k)
    return _rank(near.unionByName(far), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, keys in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            k = np.frombuffer(keys, np.int64)
            yield pa.RecordBatch.from_pydict({"qblock": pa.array([block] * len(k), pa.int64()), "pos": pa.array(np.arange(len(k), dtype=np.int32)), "q_key": pa.array(k)})


def _pack_worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        worst = pa.array([np.array(w, np.int64).tobytes() for w in b.column("w").to_pylist()], pa.binary())
        names = ["qblock", "cell", "qkeys", "qids", "qx", "qc", "qr", "least"]
        yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], worst], [*names, "worst"])
