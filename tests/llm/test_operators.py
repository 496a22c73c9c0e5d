"""The ten corpus operators against brute force, on small tables with nulls, blanks, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from lexmill.llm import decontaminate, langid, licenses, lm, packing, simhash, substring, suffixes, token_counts, topk

WORD = re.compile("[^\x20\x09-\x0d]+")
VOCAB = [f"w{i}" for i in range(60)] + ["The", "été", "naïve", "日本", "x"]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def texts(seed=3, n=60):
    """Texts with shared passages, exact and near copies, a hot passage, a long text, blanks and a null."""
    r = random.Random(seed)
    line = lambda k: " ".join(r.choice(VOCAB) for _ in range(k))
    passages = [line(45) for _ in range(4)]
    out = [line(r.randint(1, 120)) for _ in range(n)]
    for i in range(0, n, 3):
        out[i] = f"{line(5)} {passages[i % 4]}\n{line(7)}"
    out += [f"{line(3)} {passages[0]} {line(2)}" for _ in range(12)]
    out += [out[1]] * 5 + [out[2] + " tail"] + ["ab " * 300, line(4000), "", "   ", None, "one two", "a\x00b c"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 1000, t, i, "k") for i, t in enumerate(texts())]
    rows += [rows[4], (None, "lonely words here", 1, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, chunk int, score string").repartition(3).persist()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def key(r):
    return tuple((x is None, x) for x in r)


def substring_truth(rows, k):
    words = [WORD.findall(t or "") for _, t in rows]
    n = collections.Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if n[tuple(w[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("group", [256, 3, 1])
def test_substring(docs, rows, group):
    got = [tuple(r) for r in substring.substring_dedup(docs, group=group).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=key) == substring_truth(rows, 35)


def test_substring_keeps_columns(docs):
    out = substring.substring_dedup(docs, keep=True)
    assert out.columns == ["doc_id", "text", "chunk", "score", "n_words", "n_removed"]
    by = {(r.doc_id, r.chunk): r for r in out.collect()}
    for r in docs.collect():
        assert by[r.doc_id, r.chunk].score == "k"
        if not by[r.doc_id, r.chunk].n_removed:
            assert by[r.doc_id, r.chunk].text == r.text


def test_automaton_against_reference(spark):
    rng = random.Random(1)
    ref = " ".join(rng.choice(VOCAB) for _ in range(80))
    text = "head " + " ".join(ref.split()[10:60]) + " end"
    got = substring.against(spark.createDataFrame([(1, text), (2, "x"), (3, None)], "doc_id long, text string"), [ref]).collect()
    assert [tuple(r) for r in got] == [(1, 1, 50)]


def test_automaton_counts():
    rng = random.Random(2)
    for _ in range(50):
        seqs = [[rng.randint(0, 2) for _ in range(rng.randint(1, 12))] for _ in range(4)]
        a = substring.Automaton()
        paths = [a.add(s) for s in seqs]
        common = a.spread()
        count = collections.Counter(tuple(s[i:j]) for s in seqs for j in range(len(s) + 1) for i in range(j))
        for s, path in zip(seqs, paths, strict=True):
            for e, v in enumerate(path):
                want = max((m for m in range(e + 2) if m == 0 or count[tuple(s[e + 1 - m : e + 1])] > 1), default=0)
                assert (e + 1 if a.places[v] > 1 else common[v]) >= want
                assert (e + 1 if a.places[v] > 1 else min(common[v], e + 1)) == want


def suffix_truth(rows, k):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        who = math.inf if d is None else d
        for i in range(len(b) - k + 1):
            first[b[i : i + k]] = min(first.get(b[i : i + k], math.inf), who)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - k + 1):
            if first[b[i : i + k]] < (-math.inf if d is None else d):  # a row without doc_id is neither earlier nor later
                gone[i : i + k] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum())
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("group", [256, 3, 1])
def test_suffixes(docs, rows, group):
    got = [tuple(r) for r in suffixes.suffix_dedup(docs, group=group).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=key) == suffix_truth(rows, 50)


def test_longest_previous_factors():
    rng = random.Random(5)
    for _ in range(60):
        t = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30)))
        want = [max((m for m in range(len(t) - i + 1) if any(t[j : j + m] == t[i : i + m] for j in range(i))), default=0) for i in range(len(t))]
        assert suffixes.longest_previous_factors(t).tolist() == want


def test_lm(docs, rows):
    got = lm.score_documents(docs).collect()
    tok = [[lower(w) for w in WORD.findall(t or "")] + ["</s>"] for _, t in rows]
    fold = [-1 if d is None else zlib.crc32(str(d).encode()) % 5 for d, _ in rows]
    c = collections.Counter(w for x, f in zip(tok, fold, strict=True) if f not in (-1, 1) for w in x)
    n, v = sum(c.values()), len(c)
    want = [(d, f == 1, len(x), sum(c[w] > 0 for w in x), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x), 6)) for (d, _), x, f in zip(rows, tok, fold, strict=True)]
    assert sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=key) == sorted(want, key=key)
    assert all(r.score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 1.05 * sum(r.base_score for r in held)


def test_lm_weights_come_from_held_out_counts():
    code = (5 * lm.BINS + int(lm._bin(np.array([1000.0]))[0])) * lm.BINS + int(lm._bin(np.array([2.0]))[0])
    w = lm.fit([(code, 900), ((5 * lm.BINS) * lm.BINS + int(lm._bin(np.array([2.0]))[0]), 100)])
    assert w[5, 0] > 0.85 and abs(w.sum(1) - 1).max() < 1e-9 and (w[1:, 2] > 0).all()


def test_simhash(docs, rows):
    def print_of(t):
        w = WORD.findall(lower(t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {t: print_of(t) for t in {t for _, t in rows}}
    ids = collections.defaultdict(list)
    for d, t in rows:
        ids[fp[t]].append(d)
    group = {f: {f} for f in ids}
    for a in ids:
        for b in ids:
            if (a ^ b).bit_count() <= 3 and group[a] is not group[b]:
                both = group[a] | group[b]
                for x in both:
                    group[x] = both
    least = {f: min((x for g in group[f] for x in ids[g] if x is not None), default=None) for f in ids}
    want = [(d, f"{fp[t]:016x}", least[fp[t]]) for d, t in rows]
    assert sorted([tuple(r) for r in simhash.near_duplicates(docs).collect()], key=key) == sorted(want, key=key)


def test_simhash_chain_and_tiles(spark):
    """A chain of fingerprints, each within the radius of the next only, is one component; numbers far off aren't."""
    rng = random.Random(9)
    f, chain = rng.getrandbits(63), []
    for i in range(40):
        chain.append((f, 1000 - i))
        for b in rng.sample(range(63), 3):
            f ^= 1 << b
    data = [f for f, _ in chain] + [rng.getrandbits(63) for _ in range(200)]
    nodes = spark.createDataFrame([(f,) for f in data], "fp long")
    got = {r.fp: r.group for r in simhash.groups(nodes).collect()}
    label = {f: f for f in data}
    for _ in range(60):
        for a in data:
            label[a] = min(label[b] for b in data if (a ^ b).bit_count() <= 3)
    assert got == label


def test_components_of_a_long_chain_that_meets_its_least_label_last(spark):
    order = [1, *range(100, 1, -1)]
    edges = spark.createDataFrame(list(zip(order, order[1:])), "u long, v long")
    assert {r.label for r in simhash.components(edges).collect()} == {1}


def test_simhash_links_pass_through_a_row_without_id(spark):
    from unittest.mock import patch

    prints = [(1, 0), (None, 7), (2, 63), (5, (1 << 40) - 256), (9, (1 << 40) - 256)]
    docs = spark.createDataFrame([(i, str(i)) for i, _ in prints], "doc_id long, text string")
    frame = spark.createDataFrame(prints, "doc_id long, fp long")
    with patch.object(simhash, "fingerprints", lambda d, s: frame):
        got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1, 1), (None, 1), (2, 1), (5, 5), (9, 5)}


def language_docs(spark, n=120):
    base = {"en": "the and of that with which", "de": "und der die nicht mit eine", "fr": "le la des que nous est", "es": "el los que una para como"}
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(base[x].split()) for _ in range(30)), x, "s", 1) for i in range(n) for x in [list(base)[i % 4]]]
    rows += [(n, None, "en", "s", 1), (n + 1, "1234 --", "en", "s", 1), (n + 2, "", None, "s", 1), (None, "the and of", None, "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")


def test_langid(spark, empty):
    docs = language_docs(spark)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    truth = {r.doc_id: r for r in docs.collect()}
    held = [d for d, r in got.items() if r.held_out]
    assert held == [d for d in got if d is not None and zlib.crc32(str(d).encode()) % 3 == 1] or set(held) == {d for d in got if d is not None and zlib.crc32(str(d).encode()) % 3 == 1}
    ok = [got[d].lang_pred == truth[d].lang for d in held if d < 120]
    assert len(ok) > 20 and sum(ok) / len(ok) > 0.95
    assert [got[d].lang_pred for d in (120, 121, 122)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.predict(docs, langid.train(docs), keep=True)
    assert kept.columns[:5] == docs.columns and kept.columns[-1] == "score_" and kept.count() == docs.count()
    assert langid.identify(empty).count() == 0


def test_licenses(spark):
    t = "x y. Licensed under the Apache License, Version 2.0. " + "pad " * 10 + "Released under the MIT License. mit license"
    near = "This program is free software: you can redistribute it and maybe modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
    docs = spark.createDataFrame([(1, t, 0), (2, None, 0), (3, "mit, license", 0), (4, near, 0), (5, "permission is hereby granted", 0), (None, "MIT License", 0)], "doc_id long, text string, votes int")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].labels) == (3, 5, 25, "apache,mit")
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].labels, got[2].score) == (0, 0, None, "", 0.0)
    assert (got[3].n_base, got[3].base_labels) == (1, "mit")
    assert got[4].labels == "gpl" and got[4].score > 0.6
    assert got[5].labels == ""
    assert got[None].labels == "mit"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_licenses_by_row_and_by_place(spark):
    short, full = "Released under the MIT License.", dict(enumerate(t for _, t in licenses.TEMPLATES))[3]
    words = full.split()
    texts = ["nothing here", short, " ".join([short] * 3), " ".join(words[:40] + words[2:7] + words[40:]), " ".join(words[:30] + ["odd", "words"] + words[30:]), short.lower(), full[: len(full) // 4], " ".join(words[:40] + words[2:9] + words[40:])]
    rows = [(1, t) for t in texts] + [(1, texts[1]), (None, texts[1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_words, r.base_labels, r.labels, round(r.score, 6)) for r in licenses.scan(docs).collect())

    def truth(t):
        """Plain search: for each template, the cover of every group of diagonals."""
        w = licenses.license_words((t or "").encode())
        labels, best = set(), 0.0
        for label, text in licenses.TEMPLATES:
            tw = licenses.license_words(text.encode())
            n, k = len(tw), licenses.GRAM
            hits = collections.defaultdict(set)
            for i in range(len(w) - k + 1):
                for j in range(n - k + 1):
                    if w[i : i + k] == tw[j : j + k]:
                        hits[i - j].add((i, j))
            cover = lambda x: len({j + d for _, j in x for d in range(k)}) / n  # noqa: B023, E731
            near, last = [], None
            for d in sorted(hits):
                if last is None or d - last > min(licenses.SHIFT, max(1, int(n * licenses.SHARE))):
                    near.append([])
                near[-1].append(d)
                last = d
            for g in near:
                x = set().union(*(hits[d] for d in g))
                fits = max(i for i, _ in x) + k - min(i for i, _ in x) <= licenses.STRETCH * n + k
                c = cover(x) if fits else max(cover(hits[d]) for d in g)
                if c >= licenses.COVER:
                    labels.add(label)
                    best = max(best, c)
        line = " ".join(x.decode() for x in w)
        own = {v for p, v in licenses.PHRASES.items() if f" {p} " in f" {line} "}
        return len(w), ",".join(sorted(own)), ",".join(sorted(own | labels)), round(max(best, 0.5 if own else 0.0), 6)

    assert got == collections.Counter((d, *truth(t)) for d, t in rows)
    by = {t: truth(t) for t in texts}
    assert by[texts[0]][2:] == ("", 0.0) and by[texts[2]][3] == by[texts[3]][3] == 1.0


def test_topk(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(1, 8)), 60, 0), np.zeros((40, 8))])
    rows = [(i, [float(v) for v in r], "a") for i, r in enumerate(x)] + [(20, [1.0] * 8, "b"), (900, None, "n"), (901, [float("nan")] * 8, "n"), (902, [None] * 8, "n"), (None, [1.0] * 8, "n")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell string")
    data = [(i, np.floor(64 * np.array(e)).astype(np.int64)) for i, e, t in rows if t != "n"]
    want = []
    for q, (i, v) in enumerate(data):
        if i % 20 == 0:
            best = sorted((-int(v @ w), j) for p, (j, w) in enumerate(data) if p != q)[:20]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)
    few = df.limit(3)
    assert topk.top_k(few).count() == 2
    assert topk.top_k(df.where("cell = 'n'")).count() == 0


def test_cover_tree():
    x = np.random.default_rng(1).normal(size=(700, 5))
    t = topk.CoverTree(x)
    assert sorted(np.concatenate([n[3] for n in t.nodes if n[2] is None]).tolist()) == list(range(700))
    for centre, radius, kids, rows in t.nodes:
        assert np.sqrt(((x[rows] - centre) ** 2).sum(1)).max() <= radius + 1e-9
        assert kids is None or sum(len(t.nodes[k][3]) for k in kids) == len(rows)


def test_token_counts(spark):
    import sentencepiece
    from tokenizers import models

    path = token_counts.default_vocab()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    model = models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], 0, True)
    rng = random.Random(1)
    data = [t for t in texts() if t] + ["".join(rng.choice(" ▁aeth\n日é😀rx0.") for _ in range(rng.randint(1, 30))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(data)] + [(-1, None, 0), (-2, "", 0)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect()}
    assert got.pop(-1) == 0 and got.pop(-2) == 0
    assert got == {i: len(model.tokenize("▁" + t.replace(" ", "▁"))) for i, t in enumerate(data)}


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocab())
    added = ["see <|endoftext|> here.", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "a<|endoftext|", "x <|endoftext|>\n\n<|endoftext|>y"]
    rows = rows + [(5000 + i, t) for i, t in enumerate(added)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(rows[-len(added):], "doc_id long, text string"))
    got = packing.pack(docs, window=64, with_ids=True).collect()
    want = collections.Counter((d, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in rows)
    seqs, whole = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        seqs[r.sequence_id].append((r.offset, r.length))
        whole[r.sequence_id * 64 + r.offset].append((r, ids))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
    assert all(sum(n for _, n in seqs[i]) == 64 for i in range(max(seqs)))
    back, cur = collections.Counter(), None
    for g in sorted(whole):
        (r, ids), = whole[g]
        cur = ids if r.start == 0 else cur + ids
        if len(cur) == r.doc_tokens:
            back[r.doc_id, tuple(cur)] += 1
    assert back == want


def test_decontaminate(spark, empty):
    rng = random.Random(8)
    words = [f"q{i}" for i in range(400)]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (40, 20, 12, 6, 3)]
    pad = lambda n: " ".join(rng.choice(words) for _ in range(n))
    edited = items[0].split()
    edited[5] = "zz"
    del edited[20]
    edited.insert(30, "yy")
    far = items[1].split()
    far[::3] = ["no"] * len(far[::3])
    docs_ = [f"{pad(50)} {t} {pad(60)}" for t in items] + [f"{pad(9)} {' '.join(edited)} {pad(3)}", items[1].upper().replace(" ", ",\n"), f"{pad(30)} {' '.join(far)}", pad(3000), None, ""]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(docs_)], "doc_id long, text string, edits int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(77, None, "x"), (78, "...", "x")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 0), (6, 1)}
    assert got[5, 0].edits == 3 and got[0, 0].first_word == 50 and got[0, 0].similarity == 1.0
    assert {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()} == {7, 8, 9, 10}
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_edit_distance_is_exact():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randint(0, 3) for _ in range(rng.randint(1, 9))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        mask = {}
        for p, w in enumerate(a):
            mask[w] = mask.get(w, 0) | 1 << p
        assert decontaminate.best_match(mask, len(a), b)[0] == min(row)


@pytest.mark.parametrize("name", ["substring", "suffixes", "lm", "simhash", "licenses", "token_counts", "packing"])
def test_empty_tables(empty, name):
    run = {
        "substring": substring.substring_dedup, "suffixes": suffixes.suffix_dedup, "lm": lm.score_documents, "simhash": simhash.near_duplicates,
        "licenses": licenses.scan, "token_counts": token_counts.count_tokens, "packing": packing.pack,
    }[name]
    assert run(empty).count() == 0
