"""The pipeline against a brute-force version of its five stages, each on its own input."""

import collections
import random
import re

import xxhash

import corpus_pipeline as cp
from lexmill.llm import decontaminate, langid

WORD = re.compile("[^\x20\x09-\x0d]+")
STEMS = {"en": "the and of that with which have this from they", "de": "und der die nicht mit eine auch sich werden haben", "fr": "le la des que nous est dans pour avec sont", "es": "el los que una para como pero sus este más"}


def corpus():
    r = random.Random(11)

    def line(lang, k):
        return " ".join(r.choice(STEMS[lang].split()) + r.choice(["", "a", "en", "x", str(r.randint(0, 9))]) for _ in range(k))

    langs = list(STEMS)
    rows = [(i, line(langs[i % 4], r.randint(40, 90)), langs[i % 4], "s", 7) for i in range(160)]
    shared = line("en", 55)
    item = line("en", 25)
    rows += [(200 + i, f"{line('en', 20)} {shared} {line('en', 20)}", "en", "s", 7) for i in range(6)]
    rows += [(300, rows[4][1], "en", "s", 7), (301, rows[5][1], "de", "s", 7)]
    rows += [(400, f"{line('en', 30)} {item} {line('en', 30)}", "en", "s", 7), (401, None, None, "s", None), (402, "--- 12", None, "s", 6)]
    return rows, item


def fingerprint(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_pipeline(spark, tmp_path):
    rows, item = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = lambda df: {r.doc_id: r.text for r in df.collect()}

    model = langid.train(d)
    ok = {i: t for i, t, *_ in rows if t and langid.has_letter(t)}
    names, sure = model.predict(langid.features([t.encode() for t in ok.values()]))
    want = {i: ok[i] for i, s in zip(ok, sure, strict=True) if s >= cp.LEAST_SCORE}
    one = cp.language(spark, d, str(tmp_path))
    assert one.columns == d.columns and text(one) == want
    assert len(want) >= 160 and not {401, 402} & set(want)

    fp = {i: fingerprint(t) for i, t in want.items()}
    low = {i: i for i in want}
    for _ in range(8):
        low = {i: min(low[j] for j in want if (fp[i] ^ fp[j]).bit_count() <= 3) for i in want}
    want = {i: t for i, t in want.items() if low[i] == i}
    two = cp.near_dedup(spark, one, str(tmp_path))
    assert two.columns == d.columns and text(two) == want
    assert not {300, 301} & set(want)

    words = {i: WORD.findall(t) for i, t in want.items()}
    n = collections.Counter(tuple(w[i : i + 35]) for w in words.values() for i in range(len(w) - 34))
    left = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for a in range(len(w) - 34):
            if n[tuple(w[a : a + 35])] > 1:
                gone[a : a + 35] = [True] * 35
        if any(gone) and not all(gone):
            left[i] = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        elif not any(gone):
            left[i] = want[i]
    three = cp.substrings(spark, two, str(tmp_path))
    assert three.columns == d.columns and text(three) == left
    assert sum(left[i] != want[i] for i in left) == 6
    assert {r.doc_id: r.n_chars for r in three.collect()}[200] == len(left[200])

    four = cp.leaks(spark, three, str(tmp_path))
    items = decontaminate.Items.of([(1, item)])
    want = {i: t for i, t in left.items() if not decontaminate.matches(t, items)}
    assert four.columns == d.columns and text(four) == want and set(left) - set(want) == {400}

    five = cp.pack(spark, four, str(tmp_path)).collect()
    assert {r.doc_id for r in five} == set(want)
    assert sum(r.length for r in five) == sum({r.doc_id: r.doc_tokens for r in five}.values())
    places = sorted((r.sequence_id, r.offset, r.length) for r in five)
    assert all(b[1] == 0 if a[0] != b[0] else a[1] + a[2] == b[1] for a, b in zip(places, places[1:]))
    run = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in cp.run(spark, str(tmp_path)).collect())
    assert run == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in five)


def test_stages_take_empty_and_repeated_rows(spark, tmp_path):
    spark.createDataFrame([(1, "x y z")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    twice = spark.createDataFrame([(1, "the and of that with", "en", "s", 20), (1, "the and of that with", "en", "s", 20), (None, "only one", "en", "s", 8), (2, "", "en", "s", 0)], schema)
    for _, f in cp.STAGES:
        assert f(spark, empty, str(tmp_path)).count() == 0
    assert sorted(str(r.doc_id) for r in cp.near_dedup(spark, twice, str(tmp_path)).collect()) == ["1", "2", "None"]
    assert cp.substrings(spark, twice, str(tmp_path)).count() == 4
