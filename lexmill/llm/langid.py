"""Operator 8: hierarchical language identification with linear support vector machines.

Texts become frequencies of hashed byte trigrams (square-rooted, unit length). One-versus-one machines first choose
the language family; one-versus-one machines inside the winning family then choose the language. Each choice goes
by votes, ties by summed margins, then by name. Machines are fitted on a bounded, documented sample of labelled
rows: about ``SAMPLE`` different ones for each language, drawn by hash of doc_id and text, so that neither a repeated row
nor a repeated doc_id can fill or empty it. Each machine is fitted in a task of its own; the driver gets weights (16 kB a
machine, at most ``MODEL_BYTES`` in all, which is some 200 unlisted languages) and one count a label, never rows. Weights
go to tasks as a broadcast. Prediction reads whole texts, in tasks. A very long text is read in slices.

Null texts, and texts without a letter, get ``und`` and score 0. Languages that the table of families doesn't name
are families of their own. With no labelled rows all predictions are ``und``. Only text is used to predict.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import plain_docs

DIM = 1 << 12
#: Labelled rows for each language, about; the only bound on what is learned from.
SAMPLE = 500
FOLDS, HELD = 3, 1
#: Bytes of all machines' weights, at most: they are broadcast.
MODEL_BYTES = 320 << 20
#: Families of languages by code.
FAMILY = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic",
}
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def fold_of(doc_id: Column, folds: int = FOLDS) -> Column:
    """CRC-32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def features(texts: list[bytes]) -> np.ndarray:
    """A row for each text: square roots of trigram frequencies, hashed to DIM places; a space stands at both ends."""
    out = np.zeros((len(texts), DIM), np.float32)
    for i, t in enumerate(texts):
        total = np.zeros(DIM, np.int64)
        low = b" " + t.lower() + b" "
        for at in range(0, max(1, len(low) - 2), 1 << 20):  # a very long text in slices
            b = np.frombuffer(low, np.uint8)[at : at + (1 << 20) + 2].astype(np.uint32)
            h = ((b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
            total += np.bincount(h, minlength=DIM)
        out[i] = np.sqrt(total / max(1, total.sum()))
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Linear SVM (hinge loss) by dual coordinate descent; y is +1 or -1; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, alpha, norms, rng = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1), np.random.default_rng(seed)
    share = len(y) / 2 / np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum()))  # both sides weigh the same
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            g = y[i] * (w @ x[i]) - 1
            new = min(max(alpha[i] - g / norms[i], 0.0), cost * share[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def levels_of(langs: list[str], family: dict[str, str]) -> dict[str, list[str]]:
    """The classes told apart at each level: families at the top (''), then, under '/' and its name, each family's languages."""
    kin = {v: family.get(v, v) for v in langs}
    return {"": sorted(set(kin.values()))} | {f"/{f}": sorted(v for v in langs if kin[v] == f) for f in sorted(set(kin.values()))}


class Hierarchy:
    """Family machines, then language machines inside each family."""

    def __init__(self, levels: dict[str, list[str]], machines: dict[str, list[tuple[int, int, np.ndarray]]]):
        self.levels, self.machines = levels, machines

    def _choose(self, x: np.ndarray, level: str) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner and the logistic of its narrowest margin, by row."""
        n = len(self.levels[level])
        votes, margin, least = np.zeros((len(x), n)), np.zeros((len(x), n)), np.full((len(x), n), 9.0)
        for i, j, w in self.machines[level]:
            m = x @ w[:-1] + w[-1]
            for k, s in ((i, m), (j, -m)):
                votes[:, k] += s > 0
                margin[:, k] += s
                least[:, k] = np.minimum(least[:, k], s)
        best = np.where(votes == votes.max(1, keepdims=True), margin, -np.inf).argmax(1)
        return best, 1 / (1 + np.exp(-3 * least[np.arange(len(x)), best]))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        top, sure = self._choose(x, "")
        out: list[str] = [""] * len(x)
        for k, f in enumerate(self.levels[""]):
            rows = np.flatnonzero(top == k)
            if len(rows):
                best, inside = self._choose(x[rows], f"/{f}")
                sure[rows] *= inside
                for r, b in zip(rows.tolist(), best.tolist(), strict=True):
                    out[r] = self.levels[f"/{f}"][b]
        return out, sure


def _draw(docs: DataFrame, label: str, sample: int, learn: Column | None) -> tuple[DataFrame | None, list[str]]:
    """Features of about ``sample`` different labelled rows of each language (doc_id, lang, x), and the languages."""
    from_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("lang"))
    from_ = from_.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != HELD if learn is None else learn))
    place = F.xxhash64("doc_id", "text", F.lit(11))
    counts = {r["lang"]: r["n"] for r in from_.groupBy("lang").agg(F.approx_count_distinct(place, 0.02).alias("n")).collect()}
    if not counts:
        return None, []
    # The highest hash that a language's share of all 64-bit values reaches; a rare language is taken whole.
    top = {k: (1 << 63) - 1 if n <= sample else int(sample / n * 2**64) - (1 << 63) for k, n in counts.items()}
    share = F.create_map(*[F.lit(x) for k in sorted(top) for x in (k, top[k])])
    drawn = from_.where(place <= share[F.col("lang")].cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                c = b.slice(at, 64)
                x = features(c.column(1).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": c.column(0), "lang": c.column(2), "x": pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())})

    return drawn.mapInArrow(run, "doc_id long, lang string, x binary").distinct(), sorted(counts)


def train(docs: DataFrame, label: str = "lang", sample: int = SAMPLE, learn: Column | None = None, family: dict[str, str] | None = None) -> Hierarchy | None:
    """Fit on about ``sample`` labelled rows of each language among those that ``learn`` admits: a task for each pair of
    families, or of languages within one. A family's machine reads the samples of all its languages."""
    family = FAMILY if family is None else family
    rows, langs = _draw(docs, label, sample, learn)
    if rows is None:
        return None
    levels = levels_of(langs, family)
    member = [(v, "", family.get(v, v)) for v in langs] + [(v, f"/{family.get(v, v)}", v) for v in langs]
    asks = [(v, level, i, j, 1.0 if levels[level][i] == own else -1.0) for v, level, own in member for i, j in combinations(range(len(levels[level])), 2) if own in (levels[level][i], levels[level][j])]
    machines: dict[str, list[tuple[int, int, np.ndarray]]] = {level: [] for level in levels}
    if sum(len(v) * (len(v) - 1) // 2 for v in levels.values()) * 4 * (DIM + 1) > MODEL_BYTES:
        raise ValueError("too many languages for one-versus-one machines; give a table of families")
    if asks:
        pairs = docs.sparkSession.createDataFrame(asks, "lang string, level string, i int, j int, y double")

        def fit(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
            t = t.sort_values(["doc_id", "lang", "x"], kind="stable")
            x = np.stack([np.frombuffer(b, np.float16) for b in t["x"]]).astype(np.float32)
            return pd.DataFrame({"level": [key[0]], "i": [key[1]], "j": [key[2]], "w": [fit_svm(x, t["y"].to_numpy()).astype(np.float32).tobytes()]})

        fitted = rows.join(F.broadcast(pairs), "lang").groupBy("level", "i", "j").applyInPandas(fit, "level string, i int, j int, w binary")  # pairs: labels squared at most
        for r in sorted(fitted.collect(), key=lambda r: (r["level"], r["i"], r["j"])):
            machines[r["level"]].append((r["i"], r["j"], np.frombuffer(r["w"], np.float32)))
    return Hierarchy(levels, machines)


def predict(docs: DataFrame, model: Hierarchy | None, keep: bool = False) -> DataFrame:
    """doc_id, lang_pred, score; with keep, all columns of docs and these two, under names that don't clash."""
    names = ("lang_pred", "score")
    if keep:
        names = tuple(next(n for i in range(999) if (n := f"{x}{'_' * i}") not in docs.columns) for x in names)
        source = docs
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        at = docs.columns.index("text")
    else:
        source, fields, at = plain_docs(docs), "doc_id long, text string", 1

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 64):
                c = b.slice(k, 64)
                texts = c.column(at).to_pylist()
                ok = [i for i, t in enumerate(texts) if t and model is not None and has_letter(t)]
                lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if ok:
                    got, sure = model.predict(features([texts[i].encode() for i in ok]))
                    for i, v, s in zip(ok, got, sure, strict=True):
                        lang[i], score[i] = v, float(s)
                cols = c.columns if keep else [c.column(0)]
                heads = c.schema.names if keep else ["doc_id"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*heads, *names])

    return source.mapInArrow(run, f"{fields if keep else 'doc_id long'}, `{names[0]}` string, `{names[1]}` double")


def identify(docs: DataFrame, label: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; held-out rows are never learned from."""
    return predict(docs, train(docs, label, sample)).select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == HELD, F.lit(False)).alias("held_out"), "lang_pred", "score")
