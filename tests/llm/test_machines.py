"""Operator 8's machines and votes against plain ones."""

import numpy as np
import pytest

from lexmill.llm import langid


def objective(w, x, y, cost=4.0):
    x = np.hstack([x, np.ones((len(x), 1))])
    share = len(y) / 2 / np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    return 0.5 * w @ w + cost * (share * np.maximum(0, 1 - y * (x @ w))).sum()


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_svm_reaches_the_least_objective(seed):
    rng = np.random.default_rng(seed)
    y = np.where(rng.random(80) < 0.3, 1.0, -1.0)
    x = rng.normal(size=(80, 6)) * 0.4 + 0.35 * y[:, None] * rng.random(6)
    got = objective(langid.fit_svm(x, y, epochs=200), x, y)
    # Subgradient steps of falling length from zero, and from where the other ended: neither finds anything lower.
    xs, share = np.hstack([x, np.ones((80, 1))]), 40 / np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    best = np.inf
    for start in (np.zeros(7), langid.fit_svm(x, y, epochs=200)):
        w = start.copy()
        for t in range(1, 20_000):
            short = y * (xs @ w) < 1
            w -= (w - 4.0 * (share[short] * y[short]) @ xs[short]) / (t + 50)
            if t % 100 == 0:
                best = min(best, objective(w, x, y))
    assert got <= best * 1.001
    assert objective(langid.fit_svm(x, y), x, y) <= best * 1.2  # as fitted in production


def test_votes_ties_and_names():
    rng = np.random.default_rng(3)
    levels = {"": ["a", "b"], "/a": ["a1", "a2", "a3", "a4"], "/b": ["b"]}
    machine = lambda: rng.normal(size=langid.DIM + 1)
    machines = {"": [(0, 1, machine())], "/a": [(i, j, machine()) for i in range(4) for j in range(i + 1, 4)], "/b": []}
    x = rng.normal(size=(200, langid.DIM))
    got, sure = langid.Hierarchy(levels, machines).predict(x)
    tied = 0
    for row, lang, s in zip(x, got, sure, strict=True):
        level = "/a" if row @ machines[""][0][2][:-1] + machines[""][0][2][-1] > 0 else "/b"
        if level == "/b":
            assert lang == "b"
            continue
        votes, margin = [0] * 4, [0.0] * 4
        for i, j, w in machines["/a"]:
            m = row @ w[:-1] + w[-1]
            votes[i if m > 0 else j] += 1
            margin[i] += m
            margin[j] -= m
        order = sorted(range(4), key=lambda k: (-votes[k], -margin[k]))
        tied += votes[order[0]] == votes[order[1]]
        assert lang == levels["/a"][order[0]] and 0 <= s <= 1
    assert tied  # ties of votes are among the rows
    zero = {"": [(0, 1, np.zeros(langid.DIM + 1))], "/a": [(i, j, w * 0) for i, j, w in machines["/a"]], "/b": []}
    assert set(langid.Hierarchy(levels, zero).predict(x[:3])[0]) <= {"b", "a1"}  # nothing tells them apart: by name


def test_very_long_text_counts_like_its_parts():
    one = langid.features([b"ab c " * 700_000])[0]
    assert abs(float(one @ one) - 1) < 1e-3 and np.allclose(one, langid.features([b"ab c " * 4000])[0], atol=0.02)


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_BYTES", 1000)
    df = spark.createDataFrame([(0, "one text", "xx"), (2, "two text", "yy"), (3, "three", "zz")], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="too many"):
        langid.train(df, learn=langid.F.lit(True))
