"""Leaks at the bound of edits, found by samples against every window verified, and benchmarks of uneven items."""

import pickle
import random

import numpy as np
import pytest

from lexmill.llm import decontaminate


def words(k, n, prefix):
    return [f"{prefix}{k}x{i}" for i in range(n)]


@pytest.mark.parametrize("kind", ["head", "tail", "cut item", "replaced", "deleted", "mixed", "long"])
def test_recall_of_samples(kind):
    rng, texts, rows = random.Random(4), [], []
    for k in range(60 if kind == "long" else 300):
        item = words(k, 300 if kind == "long" else 50, "a")
        e = decontaminate.edits(len(item))
        before, after = words(k, 30, "b"), words(k, 30, "c")
        leak = list(item)
        if kind == "head":  # the document begins inside the item
            leak, before = leak[e:], []
        elif kind == "tail":  # the document ends inside the item
            leak, after = leak[:-e], []
        elif kind == "cut item":
            leak = leak[e // 2 : e // 2 - e]
        for p in rng.sample(range(len(item)), e) if kind in ("replaced", "long") else []:
            leak[p] = f"z{p}"
        for _ in range(e if kind in ("deleted", "mixed") else 0):
            p, do = rng.randrange(len(leak)), "d" if kind == "deleted" else rng.choice("dir")
            leak[p : p + 1] = {"d": [], "i": [leak[p], "y"], "r": ["z"]}[do]
        rows.append((k, " ".join(item)))
        texts.append(" ".join(before + leak + after))
    items = decontaminate.Items.of(rows)
    got = sum(any(m[0] == k for m in decontaminate.matches(t, items)) for k, t in enumerate(texts))
    assert got >= 0.98 * len(texts)
    lists = [decontaminate.word_hashes([w.encode() for w in t.split()]) for t in texts]
    h, bounds = np.concatenate(lists), np.cumsum([0] + [len(x) for x in lists])
    every = decontaminate._search(h, bounds, items, decontaminate.SIMILARITY, sampled=False)
    assert [d for d, v in every.items() if v[0][0] == d] == list(range(len(texts)))
    sampled = decontaminate._search(h, bounds, items, decontaminate.SIMILARITY)
    assert all(len(v) == 1 and set(v) <= set(every[d]) for d, v in sampled.items())


def test_one_long_item_among_short_ones(spark):
    rng = random.Random(5)
    long = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    short = [" ".join(words(k, 30, "s")) for k in range(200)]
    rows = [(k, t) for k, t in enumerate(short)] + [(999, " ".join(long))]
    items = decontaminate.Items.of(rows)
    assert len(pickle.dumps(items)) < 4_000_000  # 24 bytes x 3 x longest item x items would be 290 MB
    leak = long[:]
    for p in rng.sample(range(len(leak)), 3000):
        leak[p] = "zz"
    docs = spark.createDataFrame([(1, "x " + " ".join(leak) + " y"), (2, f"x {short[7]} y")], "doc_id long, text string")
    bench = spark.createDataFrame(rows, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(got) == {(1, 999), (2, 7)} and got[2, 7] == 0 and 0 < got[1, 999] <= 3000


def test_blocks_keep_to_their_bytes(spark):
    rows = [(k, " ".join(words(k, 30, "s"))) for k in range(40)] + [(99, "w " * 5000)]
    bench = spark.createDataFrame(rows, "item_id long, text string").repartition(3)
    most = 10 * decontaminate.item_bytes(rows[0][1])
    blocks = list(decontaminate._blocks(bench, "item_id", "text", most))
    assert sorted(x for b in blocks for x in b) == sorted(rows)
    assert all(len(b) == 1 or sum(decontaminate.item_bytes(t) for _, t in b) <= most for b in blocks)
    assert [(99, "w " * 5000)] in blocks and len(blocks) >= 5


def least_edits(item, text):
    """The least edit distance of the item to any stretch of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_every_window_by_plain_tables():
    r = random.Random(12)
    vocab = [f"v{i}" for i in range(25)]
    items_ = [[r.choice(vocab) for _ in range(n)] for n in (3, 5, 8, 12, 20, 30, 70)] + [["la"] * 40, ["x", "y"] * 15, ["tra", "la", "la"] * 9]
    docs = []
    for k in range(120):
        leak = list(items_[k % len(items_)])
        for _ in range(r.randint(0, decontaminate.edits(len(leak)) + 2)):
            at = r.randrange(len(leak))
            leak[at : at + r.randint(0, 1)] = [r.choice(vocab)] * r.randint(0, 1)
        docs.append([r.choice(vocab) for _ in range(r.randint(0, 40))] + leak + [r.choice(vocab) for _ in range(r.randint(0, 40))])
    items = decontaminate.Items.of([(i, " ".join(x)) for i, x in enumerate(items_)])
    want = {(d, i): e for d, text in enumerate(docs) for i, x in enumerate(items_) if (e := least_edits(x, text)) <= decontaminate.edits(len(x))}
    hashes = decontaminate.word_hashes([w.encode() for text in docs for w in text])
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in docs])])
    every = {(d, i): e for d, v in decontaminate._search(hashes, bounds, items, decontaminate.SIMILARITY, sampled=False).items() for i, _, _, e in v}
    assert every == want and len(want) > 100
    got = {(d, i): e for d, text in enumerate(docs) for i, _, _, e in decontaminate.matches(" ".join(text), items)}
    assert all(want.get(k) is not None and want[k] <= e for k, e in got.items()) and len(got) >= 0.98 * len(want)


def test_repetitive_text_is_bounded():
    import time
    import tracemalloc

    items = decontaminate.Items.of([(1, "la " * 20_000), (2, "0 1 " * 10_000)])
    tracemalloc.start()
    began = time.time()
    got = decontaminate.matches("la " * 20_000 + "0 1 " * 10_000, items)
    assert [(i, n, e) for i, _, n, e in got] == [(0, 20_000, 0), (1, 20_000, 0)]
    assert time.time() - began < 60 and tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "so a b c d e f g it is")] * 3 + [(2, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "a b c d e f g")] * 2, "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()) == [(1, 9)] * 6
