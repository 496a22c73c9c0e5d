"""Operator 11 against counting every phrase in Python, with the level tables broadcast and joined."""

import collections
import random
import re

import pytest

from lexmill.llm import phrases


def truth(rows, least, longest=5, first=2000):
    pieces = collections.defaultdict(list)
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        pieces[lang or "und"] += [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]
    out = []
    for lang, every in pieces.items():
        f = collections.Counter(tuple(w[i : i + k]) for w in every for k in range(1, longest + 1) for i in range(len(w) - k + 1))
        n = sum(len(w) for w in every)
        found = {g for g, a in f.items() if len(g) > 1 and a >= least}
        inside = {g[i : i + k] for g in found for k in range(2, len(g)) for i in range(len(g) - k + 1) if f[g] >= f[g[i : i + k]]}
        scored = []
        for g in found - inside:
            score, cut = min((1000 * f[g] * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -f[g], " ".join(g).encode(), f[g[:cut]], f[g[cut:]]))
        out += [(lang, r, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:first], 1)]
    return sorted(out)


def texts():
    r = random.Random(6)
    words = [f"w{i}" for i in range(30)] + ["The", "été", "日本", "x|y"]
    fixed = ["new york city", "United States of America", "in order to be", "new york times"]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    rows = [(r.choice(["en", "en", "de", None, "und"]), f"{line(r.randint(0, 20))} {r.choice(fixed)}{r.choice([' ', ', ', chr(10), chr(9), '; '])}{line(9)}") for _ in range(300)]
    return rows + [("en", None), ("en", ""), (None, " ,, "), ("de", "ab " * 3000), ("en", "go. " * 500), ("de", "a b c d e " * 60)] + rows[:5] * 3


@pytest.mark.parametrize(("bound", "block"), [(48 << 20, 2 << 20), (48 << 20, 900), (-1, 900)])
def test_collocations(spark, monkeypatch, bound, block):
    monkeypatch.setattr(phrases, "BROADCAST_BYTES", bound)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    monkeypatch.setattr(phrases, "HELD", 200)
    rows = texts()
    df = spark.createDataFrame([(i, t, lang, 1, "k") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n int, phrase string").repartition(3)
    got = [tuple(r) for r in phrases.collocations(df, least=8).collect()]
    assert sorted(got) == truth(rows, 8)
    assert any(len(g[2].split()) == 5 for g in got)


def test_first_of_each_language(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(df, least=6, first=7).collect()) == truth(rows, 6, first=7)


def test_scores_past_64_bits(spark):
    level = spark.createDataFrame([("en", 10**15, 10**15, 10**15, 10**15)], "lang string, n long, words long, first1 long, rest1 long")
    score = level.select(phrases.cut_score("first1", "rest1").alias("s")).first().s
    assert score == 1000
    big = spark.createDataFrame([(10**12 + 7, 10**15 + 1, 10**13 + 3, 10**13 + 9)], "n long, words long, first1 long, rest1 long")
    assert big.select(phrases.cut_score("first1", "rest1").alias("s")).first().s == 1000 * (10**12 + 7) * (10**15 + 1) // ((10**13 + 3) * (10**13 + 9))


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_tables_of_a_level_are_not_broadcast_by_spark(spark, tmp_path):
    words = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, " ".join(words[(i + j) % 4] for j in range(12)), "en") for i in range(20)], "doc_id long, text string, lang string")
    plan = phrases.collocations(df, least=8)._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join " in x]
    # The languages' own word counts alone, one join a level; what stands in longer phrases is merged.
    assert len([x for x in joins if "BroadcastHashJoin [lang" in x]) == 4 and len([x for x in joins if "SortMergeJoin [id" in x]) == 3 and len(joins) == 7
    asked = spark.createDataFrame([(1, "en", "a")], "block long, lang string, phrase string")
    known = spark.createDataFrame([("en", "a", 7)], "lang string, phrase string, id long")
    joined = phrases.salted_join(asked, known, ["lang", "phrase"])
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString() and joined.first().id == 7
    blobs = phrases.packed(known, "lang", "phrase", "id")
    assert [r.to_pylist() for r in phrases.unpacked(blobs.value)] == [[{"lang": "en", "phrase": "a", "id": 7}]]
