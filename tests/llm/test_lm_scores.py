"""The language model's scores against counts, weights and sums in plain Python."""

import collections
import math
import random
import re
import zlib

from lexmill.llm import lm

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows):
    tokens = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")] + [None] for _, t in rows]
    fold = [-1 if d is None else zlib.crc32(str(d).encode()) % 5 for d, _ in rows]
    pairs = [list(zip([None, *x], x)) for x in tokens]  # the end is the context of the first word
    count = lambda source, ok: collections.Counter(x for xs, f in zip(source, fold, strict=True) if ok(f) for x in xs)
    train, kept = (lambda f: f not in (-1, lm.HELD)), (lambda f: f not in (-1, lm.HELD, lm.DELETED))
    c1, c2, k1, k2 = count(tokens, train), count(pairs, train), count(tokens, kept), count(pairs, kept)
    uniform = 1 / (len(c1) + 1)

    def level(n):
        return min(n.bit_length(), lm.CONTEXTS - 1)

    def binned(r):
        return 0.0 if r <= 0 else 2 ** ((min(max(math.floor(math.log2(r) * lm.STEP) - lm.LOW * lm.STEP, 1), lm.BINS - 1) + lm.LOW * lm.STEP + 0.5) / lm.STEP)

    seen = collections.defaultdict(list)
    for xs, f in zip(pairs, fold, strict=True):
        if f == lm.DELETED:
            for v, w in xs:
                seen[level(k1[v])].append((binned(k2[v, w] / max(k1[v], 1) / uniform), binned(k1[w] / max(sum(k1.values()), 1) / uniform), 1.0))
    weights, last = [], (0.0, 0.9, 0.1)
    for b in range(lm.CONTEXTS):
        if seen[b]:
            w, more = ((0.5, 0.4, 0.1), (0.5, 0.5, 0.5)) if b else ((0.0, 0.9, 0.1), (0.0, 0.5, 0.5))
            for _ in range(100):
                total = list(more)
                for parts in seen[b]:
                    z = sum(a * p for a, p in zip(w, parts, strict=True))
                    total = [t + a * p / z for t, a, p in zip(total, w, parts, strict=True)]
                w = tuple(t / sum(total) for t in total)
            last = w
        weights.append(last)
    n, out = sum(c1.values()), []
    for xs in pairs:
        s = 0.0
        for v, w in xs:
            a, b, c = weights[level(c1[v])]
            s += math.log10(a * c2[v, w] / max(c1[v], 1) + b * c1[w] / max(n, 1) + c * uniform)
        out.append(s)
    return out


def test_scores(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["The", "the", "été", "x<y"]
    rows = [(i, " ".join(r.choice(words[: r.choice([3, 12, 44])]) for _ in range(r.randint(0, 60)))) for i in range(120)]
    rows += [(3, rows[3][1]), (None, "the w1 w2"), (500, None), (501, "never seen words"), (502, "w1 " * 3000)]
    got = lm.score_documents(spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, score double").repartition(3)).collect()
    key = lambda d, n, s: (d is None, d, n, s)
    want = sorted(key(d, len(WORD.findall(t or "")) + 1, s) for (d, t), s in zip(rows, brute(rows), strict=True))
    for a, b in zip(sorted(key(x.doc_id, x.n_tokens, x.score) for x in got), want, strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) <= 1e-9 * max(1, abs(b[3]))
