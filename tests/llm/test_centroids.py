"""Operator 13 against rounds that hold every vector against every centroid, in Python integers."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from lexmill.llm import centroids

D, K, ROUNDS = 6, 7, 3


def truth(rows, k=K, rounds=ROUNDS, d=D, scale=256):
    kept = [(i, [math.floor(Fraction(x) * scale) for x in e], e) for i, e in rows if e is not None and len(e) == d and all(x is not None and math.isfinite(x) for x in e)]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), e, v) for i, v, e in kept if i is not None)[:k]
    z = [v for *_, v in seeds]
    if not z:
        return []
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        own = [min(range(len(z)), key=lambda c: (far(v, z[c]), c)) for _, v, _ in kept]
        if step < rounds:
            for c in range(len(z)):
                mine = [v for (_, v, _), o in zip(kept, own, strict=True) if o == c]
                if mine:
                    z[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    dist = [far(v, z[c]) for (_, v, _), c in zip(kept, own, strict=True)]
    cap = lambda x: min(x, (1 << 63) - 1)
    by = {c: sum(x for x, o in zip(dist, own, strict=True) if o == c) for c in range(len(z))}
    return [(i, c, cap(x), cap(by[c]), cap(sum(dist)), hashlib.sha256(",".join(map(str, z[c])).encode()).hexdigest()) for (i, *_), c, x in zip(kept, own, dist, strict=True)]


def key(r):
    return tuple((x is None, x) for x in r)


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id long, embedding array<double>, cluster int, e string").repartition(3)
    got = [tuple(r) for r in centroids.cluster(df, k=K, rounds=ROUNDS, dims=D, **kw).collect()]
    assert sorted(got, key=key) == sorted(truth(rows, scale=kw.get("scale", 256)), key=key)


def rows(spread=1.0, n=400):
    rng = np.random.default_rng(4)
    hubs = rng.normal(size=(9, D)) * spread
    x = [(i, (hubs[i % 9] + rng.normal(size=D) * 0.05 * spread).tolist()) for i in range(n)]
    x += [(1000 + i, hubs[0].tolist()) for i in range(300)]  # a vector that is repeated 300 times
    x += [(None, [0.5] * D), (7, [9.0] * D), (7, [8.0] * D), x[3], (901, None), (902, [1.0]), (903, [None] * D), (904, [float("nan")] * D), (905, [float("inf")] + [0.0] * (D - 1))]
    return x


def test_clusters(spark, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 100)
    check(spark, rows())


@pytest.mark.parametrize("spread", [1e4, 3e6, 1e20])
def test_large_components(spark, spread):
    check(spark, rows(spread, 120))


def test_ties_go_to_the_smaller_number(spark):
    check(spark, [(i, [float(i % 3)] * D) for i in range(60)], scale=1)


def test_few_and_none(spark):
    check(spark, rows()[:3])
    check(spark, [(None, [0.0] * D)])
    assert centroids.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_nodes_are_assigned_whole():
    rng = np.random.default_rng(0)
    x = np.floor(np.concatenate([rng.normal(size=(2000, 3)) * 20 + c for c in ([0, 0, 0], [900, 0, 0], [0, 900, 500])]))
    tree = centroids.Tree.build(np.arange(len(x)), np.zeros(len(x), bool), x)
    tree = centroids.Tree.unpack(tree.pack(), 3)
    z = [[0, 0, 0], [900, 0, 0], [0, 900, 500]]  # halves straddle the groups, so a few leaves stay open
    whole, at, *_ = centroids.walk(tree, z)
    assert len(at) < 300 and sum(len(n) for _, n in whole) < 60
    total = centroids.totals(tree, z)
    assert total[:, -1].tolist() == [2000, 2000, 2000] and total[:, :3].tolist() == [x[i : i + 2000].sum(0).astype(int).tolist() for i in (0, 2000, 4000)]
    # A centroid as near as the nearest at a corner is kept: the leaf decides by its number.
    tie = centroids.Tree.build(np.arange(1), np.zeros(1, bool), np.array([[1.0, 0.0, 0.0]]))
    assert centroids.assign(tie, [[2, 0, 0], [0, 0, 0]])[0].tolist() == [0]
    assert centroids.assign(tie, [[0, 0, 0], [2, 0, 0]])[0].tolist() == [0]
