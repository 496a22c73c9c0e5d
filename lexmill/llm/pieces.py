"""Operator 12: encoding and decoding with a merge-type sentencepiece vocabulary.

A text's spaces become U+2581, one more is put in front, and every character starts as a symbol. An agenda of adjacent
pairs that form a piece is worked off by score, best first; of equal scores the leftmost pair is merged first. Symbols
that are no piece become one byte piece for each of their UTF-8 bytes. No piece may hold U+2581 after another
character, so no merge crosses into a run of U+2581 that follows text: words are encoded one by one and remembered.
A batch's new words are worked off together: those of one length are rows of a matrix whose agenda is a matrix of
scores. A long word keeps a heap of its own.

Decoding joins the pieces' texts, turns U+2581 into spaces, drops the space put in front and the control pieces, and
reads runs of byte pieces as UTF-8, each byte that fits nowhere as U+FFFD.

Ids are held against the sentencepiece library: each Arrow batch gives it the words that are new, many to a text, and
``agrees`` says for each row whether it has the same ids for all its words. Tests hold whole texts against it, and the
decoding of any ids.

Null texts count as empty: the end id alone, which decodes to an empty text. A very long text is worked off like any
other. Equal scores fall to the left, as said. Repeated rows
and doc_ids give a row each, a null doc_id stays null, other columns of the caller take no part whatever they are
called. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_docs, text_batches

SPACE = "▁"
#: Text of an Arrow batch that is encoded, checked and sent on together.
BATCH_BYTES = 2 << 20
#: Symbols of a word that is merged in a matrix.
LONGEST = 48
#: Words remembered; a batch that would pass it makes the codec forget all before.
MOST = 200_000
#: Code points whose characters' pairs are looked up in a square table.
LOW = 0x250
#: Ids whose bytes are gathered together.
GATHERED = 500_000
NONE = float("-inf")
ENCODED = "doc_id long, n_tokens long, ids array<int>, decoded string, agrees boolean"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encoder and decoder for one model file. Files of other kinds (unigram, normalising, without byte pieces,
    with user-defined or unused pieces) are refused."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        kind = {n: spec.SentencePiece.Type.Value(n) for n in spec.SentencePiece.Type.keys()}
        norm, train = spec.normalizer_spec, spec.trainer_spec
        inner = any(SPACE in p.piece.lstrip(SPACE) for p in spec.pieces if p.type == kind["NORMAL"])
        if (
            train.model_type != train.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix
            or train.treat_whitespace_as_suffix or inner or any(p.type in (kind["USER_DEFINED"], kind["UNUSED"]) for p in spec.pieces)
        ):
            raise ValueError(f"not a plain merge-type vocabulary: {path}")
        self.score = {p.piece: float(p.score) for p in spec.pieces if p.type == kind["NORMAL"]}
        self.id = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kind["NORMAL"]}
        # A byte piece's name is its value between "<0x" and ">".
        self.value = {i: int(p.piece[3:5], 16) for i, p in enumerate(spec.pieces) if p.type == kind["BYTE"]}
        self.byte_id = {v: i for i, v in self.value.items()}
        if len(self.byte_id) != 256:
            raise ValueError(f"a vocabulary without byte pieces: {path}")
        self.end_id = train.eos_id
        shown = {i: train.unk_surface for i, p in enumerate(spec.pieces) if p.type == kind["UNKNOWN"]}
        self.raw = [
            bytes([self.value[i]]) if i in self.value else b"" if p.type == kind["CONTROL"] else shown.get(i, p.piece.replace(SPACE, " ")).encode()
            for i, p in enumerate(spec.pieces)
        ]
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_size = np.array([len(r) for r in self.raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.is_control = np.array([p.type == kind["CONTROL"] for p in spec.pieces])
        self.opens = np.array([p.type == kind["NORMAL"] and p.piece.startswith(SPACE) for p in spec.pieces])
        self.words: dict[str, bytes] = {}
        self.differ: set[str] = set()  # words for which the library has other ids or another text
        self._pairs()

    def _pairs(self) -> None:
        """The pairs that form a piece, by the ids of their halves, and the id of each character that is a piece."""
        self.char = np.full(0x110000, len(self.raw), np.int32)  # a character that is no piece: an id past all others
        for piece, i in self.id.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        halves = [(self.id[p[:j]], self.id[p[j:]], i, self.score[p]) for p, i in self.id.items() for j in range(1, len(p)) if p[:j] in self.id and p[j:] in self.id]
        halves.sort()
        self.wide = len(self.raw) + 1
        self.pair = np.array([a * self.wide + b for a, b, _, _ in halves], np.int64)
        self.both = np.array([i for *_, i, _ in halves], np.int32)
        self.worth = np.array([w for *_, w in halves])
        # Words begin as characters: the pairs of those with low code points stand in a square table.
        self.low = np.full(self.wide, -1, np.int64)
        chars = np.unique(self.char[:LOW])
        self.low[chars] = np.arange(len(chars))
        self.low[len(self.raw)] = -1
        a, b = (x.ravel() for x in np.meshgrid(chars, chars, indexing="ij"))
        self.square_worth, self.square_both = (x.reshape(len(chars), len(chars)) for x in self._search(a, b))

    def _first(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``_search`` for pairs of characters."""
        x, y = self.low[a], self.low[b]
        score, both = self.square_worth[x, y], self.square_both[x, y]
        high = (x < 0) | (y < 0)
        if high.any():
            score[high], both[high] = self._search(a[high], b[high])
        return score, both

    def _search(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the piece that each pair forms; no piece: the least number."""
        ask = a.astype(np.int64) * self.wide + b
        at = np.minimum(np.searchsorted(self.pair, ask), len(self.pair) - 1)
        return np.where(self.pair[at] == ask, self.worth[at], NONE), self.both[at]

    def _matrix(self, s: np.ndarray, rows: np.ndarray, out: list[bytes]) -> None:
        """Merge the best pair of each row of s until none is left, and put each row's ids into out."""
        score, both = self._first(s[:, :-1], s[:, 1:])
        while len(rows):
            at = score.argmax(1) if score.shape[1] else np.zeros(len(rows), np.int64)
            done = score[np.arange(len(rows)), at] == NONE if score.shape[1] else np.ones(len(rows), bool)
            if done.any():
                blob, width = s[done].astype("<i4").tobytes(), 4 * s.shape[1]
                for j, r in enumerate(rows[done].tolist()):
                    out[r] = blob[j * width : (j + 1) * width]
                on = ~done
                s, rows, at, score, both = s[on], rows[on], at[on], score[on], both[on]
                if not len(rows):
                    return
            each = np.arange(len(rows))
            s[each, at] = both[each, at]
            left = np.ones(s.shape, bool)
            left[each, at + 1] = False
            s = s[left].reshape(len(rows), -1)
            left = np.ones(score.shape, bool)
            left[each, at] = False
            score, both = (m[left].reshape(len(rows), -1) for m in (score, both))
            for r, i in ((np.flatnonzero(at > 0), at[at > 0] - 1), (np.flatnonzero(at < score.shape[1]), at[at < score.shape[1]])):
                score[r, i], both[r, i] = self._search(s[r, i], s[r, i + 1])

    def many(self, words: list[str]) -> list[bytes]:
        """The ids of words, each with U+2581 put in front."""
        out = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        chars = self.char[np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le"), "<u4")] if words else np.zeros(0, np.int32)
        first = np.cumsum(size) - size
        unknown = chars == len(self.raw)
        strange = np.add.reduceat(unknown, first) > 0 if words else np.zeros(0, bool)
        slow = size > LONGEST
        for r in np.flatnonzero(slow).tolist():
            out[r] = np.array(self.symbols_to_ids(self.merged(SPACE + words[r])), "<i4").tobytes()
        for n in np.unique(size[~slow]).tolist():
            rows = np.flatnonzero(~slow & (size == n))
            self._matrix(chars[first[rows][:, None] + np.arange(n)], rows, out)
        for r in np.flatnonzero(strange & ~slow).tolist():  # the bytes of characters that are no piece
            lost = iter([c for c, u in zip(SPACE + words[r], unknown[first[r] : first[r] + size[r]].tolist(), strict=True) if u])
            ids = [i for x in np.frombuffer(out[r], "<i4").tolist() for i in ([x] if x < len(self.raw) else [self.byte_id[b] for b in next(lost).encode()])]
            out[r] = np.array(ids, "<i4").tobytes()
        return out

    def learn(self, texts: list[list[str]], lib=None) -> None:
        """Encode the words of texts that are new, and hold them against the library if one is given."""
        every = set().union(*texts)
        if len(self.words) + len(every) > MOST:
            self.words.clear()
            self.differ.clear()
        new = list(every - self.words.keys())
        self.words.update(zip(new, self.many(new), strict=True))
        if lib is not None:
            self._hold(new, lib)

    def _hold(self, words: list[str], lib, group: int = 500) -> None:
        """Hold words against the library, as texts of many words; where one differs, each of its words by itself."""
        alone = [w for w in words if w[-1:] == SPACE]  # spaces at a text's end
        words = [w for w in words if w and w[-1] != SPACE] if alone else [w for w in words if w]
        groups = [words[i : i + group] for i in range(0, len(words), group)] + [[w] for w in alone]
        while groups:
            # Each word's first space is the one that parts it from the word before, or the one the library puts in front.
            theirs = lib.encode([" ".join(g).replace(SPACE, " ") for g in groups], num_threads=1)
            own = [np.frombuffer(b"".join(map(self.words.__getitem__, g)), "<i4").tolist() for g in groups]
            bad = [g for g, a, b in zip(groups, own, theirs, strict=True) if a != b]
            self.differ.update(g[0] for g in bad if len(g) == 1)
            groups = [[w] for g in bad if len(g) > 1 for w in g]

    def merged(self, s: str) -> list[str]:
        """The symbols of s when no adjacent pair forms a piece any more."""
        sym = list(s)
        n, get = len(sym), self.score.get
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                both = sym[left] + sym[right]
                s = get(both)
                if s is not None:
                    heapq.heappush(agenda, (-s, left, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, both = heapq.heappop(agenda)
            right = after[left]
            # The pair is out of date if either half was merged since: then the two no longer spell it.
            if not sym[left] or right < 0 or sym[left] + sym[right] != both:
                continue
            sym[left], sym[right] = both, ""
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [x for x in sym if x]

    def symbols_to_ids(self, symbols: Iterable[str]) -> list[int]:
        out: list[int] = []
        for s in symbols:
            i = self.id.get(s)
            if i is None:
                out.extend(self.byte_id[b] for b in s.encode())
            else:
                out.append(i)
        return out

    def parts(self, text: str) -> list[str]:
        """The words of text, each as what follows its U+2581; none for an empty text."""
        if not text:
            return []
        parts = text.replace(SPACE, " ").split(" ")
        if "" in parts:  # several spaces on end, or one at an end: they stand before the next word, or for themselves
            words, run = [], 0
            for p in parts:
                if p:
                    words.append(SPACE * run + p)
                    run = 0
                else:
                    run += 1
            parts = words + ([SPACE * (run - 1)] if run else [])
        return parts

    def encode(self, texts: list[str], lib=None) -> tuple[list[bytes], list[bool]]:
        """The ids of texts and the end id, as little-endian 32-bit numbers, and whether the library agrees."""
        words = [self.parts(t) for t in texts]
        self.learn(words, lib)
        end = self.end_id.to_bytes(4, "little")
        return [b"".join(map(self.words.__getitem__, w)) + end for w in words], [not self.differ or self.differ.isdisjoint(w) for w in words]

    def decode(self, ids: list[int]) -> str:
        return self.decode_many(np.array(ids, np.int64), np.array([len(ids)]))[0]

    def decode_many(self, flat: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of lists of ids, given on end. The pieces' bytes are gathered for all of them at once; a list whose
        bytes are no UTF-8, or that holds control pieces elsewhere than at its end, is decoded by itself."""
        if len(flat) and not (flat.min() >= 0 and flat.max() < len(self.raw)):
            raise ValueError("an id that the vocabulary lacks")
        size = self.raw_size[flat]
        at = np.cumsum(size)
        data = b"".join(self._gathered(flat[i : i + GATHERED]) for i in range(0, len(flat), GATHERED))
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
        edges = np.concatenate([np.zeros(1, np.int64), at])
        controls = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.is_control[flat])])
        out = []
        for a, b, x, y, k in zip(starts.tolist(), ends.tolist(), edges[starts].tolist(), edges[ends].tolist(), (controls[ends] - controls[starts]).tolist(), strict=True):
            if k <= 1 and (not k or self.is_control[flat[b - 1]]):
                try:
                    out.append(data[x + (a < b and bool(self.opens[flat[a]])) : y].decode())
                    continue
                except UnicodeDecodeError:
                    pass
            ids = flat[a:b].tolist()
            first = next((i for i in ids if not self.is_control[i]), None)
            out.append(self._decode_bytes(ids)[1 if first is not None and self.opens[first] else 0 :])
        return out

    def _gathered(self, flat: np.ndarray) -> bytes:
        size = self.raw_size[flat]
        at = np.cumsum(size)
        return self.raw_bytes[np.repeat(self.raw_start[flat] - at + size, size) + np.arange(at[-1])].tobytes()

    def _decode_bytes(self, ids: list[int]) -> str:
        """Byte pieces that are no UTF-8 among them: each such byte is U+FFFD by itself."""
        out: list[str] = []
        run = bytearray()

        def close() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        c = bytes(run[at : at + n]).decode()
                    except UnicodeDecodeError:
                        continue
                    out.append(c)
                    at += n
                    break
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if i in self.value:
                run.append(self.value[i])
            else:
                close()
                out.append(self.raw[i].decode())
        close()
        return "".join(out)


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=1)
def library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens (ids, the end id included), ids, decoded (the text of those ids) and agrees for every row."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lib = codec(path), library(path)
        for ids, texts, rest in text_batches(batches, BATCH_BYTES):
            plain = [t.decode() if t else "" for t in texts]
            blobs, agrees = own.encode(plain, lib)
            sizes = np.array([len(b) // 4 for b in blobs], np.int64)
            flat = np.frombuffer(b"".join(blobs), "<i4")
            ends = np.cumsum(sizes)
            decoded = own.decode_many(flat, ends)
            offsets = np.concatenate([np.zeros(1, np.int64), ends])
            yield pa.RecordBatch.from_pydict({
                "doc_id": rest.column(0).combine_chunks(), "n_tokens": pa.array(sizes),
                "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())),
                "decoded": pa.array(decoded, pa.string()), "agrees": pa.array(agrees, pa.bool_()),
            })

    # doc_id goes along twice: text_batches reads the first as a key and hands on the rest unchanged, nulls included.
    return plain_docs(docs).select("doc_id", "text", F.col("doc_id").alias("own")).mapInArrow(run, ENCODED)


def decode(rows: DataFrame, ids: str = "ids", model: str | None = None) -> DataFrame:
    """The column doc_id and ``decoded``, the text of each row's ids (a null list: null; null ids are left out)."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            texts = [None if x is None else own.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "decoded": pa.array(texts, pa.string())})

    own_ids = F.array_compact(F.col(f"`{ids}`").cast("array<int>"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), own_ids.alias("ids")).mapInArrow(run, "doc_id long, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """The digests of what ``encode`` returns: decimal ids joined by one space, and the decoded text."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")
