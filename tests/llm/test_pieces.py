"""Operator 12 against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from lexmill.llm import pieces


@pytest.fixture(scope="module")
def own():
    return pieces.Codec(pieces.default_model())


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def texts():
    r = random.Random(5)
    some = ["".join(r.choice(" ▁aeth\n日é😀rx0.\x00\t") for _ in range(r.randint(0, 50))) for _ in range(400)]
    fixed = ["", " ", "   ", "▁", "x▁", "the quick", "  the  fox  ", "thequick" * 50, "a" * 700, " " * 300, "<s></s><0x0A>", "日本" * 200, "the " * 5000]
    return some + fixed


def test_encode_and_decode_query(spark, lib):
    rows = [(i, t, "k", 1) for i, t in enumerate(texts())]
    rows += [(7, None, "k", 1), (None, "no id", "k", 1), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    got = pieces.digests(pieces.encode(df)).collect()
    want = []
    for i, t, *_ in rows:
        ids = lib.encode(t or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest(), True))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def ids_of(blob):
    return np.frombuffer(blob, "<i4").tolist()


def test_whole_texts(own, lib):
    blobs, agrees = own.encode(texts(), lib)
    assert [ids_of(b) for b in blobs] == lib.encode(texts(), add_eos=True) and all(agrees)


def test_both_agendas_agree(own):
    words = sorted({w for t in texts() for w in own.parts(t)})
    assert [ids_of(b) for b in own.many(words)] == [own.symbols_to_ids(own.merged("▁" + w)) for w in words]


def test_disagreement_is_told(lib):
    class Other:
        encode = staticmethod(lambda words, num_threads: [lib.encode(w.replace("fox", "hen")) for w in words])
        decode = staticmethod(lambda ids, num_threads: lib.decode(ids))

    assert pieces.Codec(pieces.default_model()).encode(["a fox", "a hen", ""], Other)[1] == [False, True, True]


def test_decode_any_ids(own, lib):
    r = random.Random(2)
    for _ in range(5000):
        ids = [r.choice([r.randrange(32000), r.randrange(259), r.randrange(3, 259), 0, 1, 2]) for _ in range(r.randint(0, 9))]
        assert own.decode(ids) == lib.decode(ids)
    with pytest.raises(ValueError, match="lacks"):
        own.decode([32000])


def test_decode_frame(spark, lib):
    lists = [(1, lib.encode("A fox, née 狐 🦊.", add_eos=True)), (2, []), (3, None), (4, [300, None, 2])]
    df = spark.createDataFrame(lists, "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in pieces.decode(df).collect()} == {1: "A fox, née 狐 🦊.", 2: "", 3: None, 4: lib.decode([300, 2])}


def test_words_forget(lib, monkeypatch):
    monkeypatch.setattr(pieces, "MOST", 3)
    own = pieces.Codec(pieces.default_model())
    for t in ["one two three four five one two " * 20, "one two", "six two"]:
        assert ids_of(own.encode([t])[0][0]) == lib.encode(t, add_eos=True)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert pieces.digests(pieces.encode(empty)).count() == 0


def test_other_kinds_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    with open(pieces.default_model(), "rb") as f:
        spec.ParseFromString(f.read())
    spec.trainer_spec.model_type = spec.trainer_spec.UNIGRAM
    path = tmp_path / "other.model"
    path.write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError, match="merge-type"):
        pieces.Codec(str(path))
