"""Operator 9: token counts under a unigram vocabulary, by count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary's pieces that end at each character; dynamic programming carries
the best score and the piece count that goes with it, never the pieces themselves. Rules are those of the
tokenizers library's Unigram model with byte fallback: an unknown character scores the least piece score minus 10 and costs one token a byte;
of equal scores the candidate that starts first wins; spaces become U+2581, with one put before the text.

No piece has U+2581 after another character, so a best path is cut before each run of U+2581 that follows text, and
words can be counted one by one and remembered. Scores are summed in double precision (whole numbers here, so exactly).

The vocabulary is the public 32k sentencepiece file, its pieces and scores read as a unigram model; the path is a
parameter and nothing is trained. Null texts count as empty: 0 tokens. A very long text is counted word by word; equal
scores fall to the earlier start, as said. Repeated rows give a row each; columns other than doc_id and text take no part,
whatever they are called. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import plain_docs

SPACE = "▁"
PENALTY = 10.0


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces and their scores: no control, unknown, unused or byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]


class Counter:
    """Counts tokens of texts; remembers up to MOST distinct words."""

    MOST = 500_000

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for piece, score in pieces:
            self.auto.add_word(piece, (len(piece), float(score)))
        self.auto.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p, _ in pieces)
        self.seen: dict[str, tuple[int, float]] = {}

    def viterbi(self, s: str) -> tuple[int, float]:
        """(tokens, score) of the best path over s."""
        n = len(s)
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        done = 0

        def unknown(end: int) -> None:
            c = s[end - 1]
            if c not in self.single:
                x = best[end - 1] + self.unknown
                if best[end] is None or x > best[end]:
                    best[end], count[end] = x, count[end - 1] + len(c.encode())

        for last, (length, score) in self.auto.iter(s):  # longest first at each end
            end = last + 1
            while done < end - 1:
                done += 1
                unknown(done)
            x = best[end - length] + score
            if best[end] is None or x > best[end]:
                best[end], count[end] = x, count[end - length] + 1
        while done < n:
            done += 1
            unknown(done)
        return count[n], best[n]

    def word(self, w: str) -> tuple[int, float]:
        got = self.seen.get(w)
        if got is None:
            if len(self.seen) >= self.MOST:
                self.seen.clear()
            got = self.seen[w] = self.viterbi(w)
        return got

    def text(self, t: str) -> tuple[int, float]:
        if not t:
            return 0, 0.0
        if not self.by_word:
            return self.viterbi(SPACE + t.replace(" ", SPACE))
        n, total, run = 0, 0.0, 1
        seen = self.seen
        for w in t.replace(SPACE, " ").split(" "):
            if not w:  # another space before the next word, or spaces at the end
                run += 1
                continue
            w = SPACE * run + w
            run = 1
            k, s = seen.get(w) or self.word(w)
            n += k
            total += s
        if run > 1:
            k, s = self.word(SPACE * (run - 1))
            n += k
            total += s
        return n, total


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(read_pieces(path))


def count_tokens(docs: DataFrame, vocab_path: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_tokens, score (the best path's sum of piece scores) for every row."""
    path = vocab_path or default_vocab()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            got = [c.text(t) for t in texts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column(0), "n_chars": pa.array(map(len, texts), pa.int64()),
                "n_tokens": pa.array([n for n, _ in got], pa.int64()), "score": pa.array([s for _, s in got], pa.float64()),
            })

    return plain_docs(docs).mapInArrow(run, "doc_id long, n_chars long, n_tokens long, score double")
