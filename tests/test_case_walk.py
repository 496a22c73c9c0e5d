"""Large files of a case are hashed by tasks in turn, each of which reads a part."""

import hashlib
import os

from lexmill.functions import digests
from lexmill.sources import texts


def _walked(df):
    return {r.rel_path: (r.bytes, r.sha256) for r in df.collect()}


def test_a_file_that_is_too_large_for_one_row(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"A")
    for p in ("b", ".git", "nested"):  # without blocks on disk
        (tmp_path / p).mkdir()
        with open(tmp_path / p / "c", "wb") as f:
            f.write(b"first")
            f.truncate(2**31 + 5)
    nested = spark.createDataFrame([("nested",)], "root string")
    of_b = "f8b1eac262101a4bfe16f9d01ae48988ca686852b96f519c4689f150aa0748ce"
    got = _walked(texts.case_files(spark, str(tmp_path), nested))
    assert set(got) == {"a", "b/c"} and got["a"] == (1, hashlib.sha256(b"A").hexdigest())
    assert got["b/c"] == (2**31 + 5, of_b)


def test_turns(spark, tmp_path):
    sizes = {"whole": 1000, "over": 1001, "x y": 1400, "z%20[1]é": 2101, "sub/w": 699, "sub/v": 5000}
    (tmp_path / "sub").mkdir()
    for p, n in sizes.items():
        (tmp_path / p).write_bytes(os.urandom(n))
    want = {p: (n, hashlib.sha256((tmp_path / p).read_bytes()).hexdigest()) for p, n in sizes.items()}
    for turn in (333, 700, 10**6):
        assert _walked(texts.case_files(spark, str(tmp_path), whole=1000, turn=turn)) == want
    times = {r.rel_path: r.mtime for r in texts.case_files(spark, str(tmp_path)).collect()}
    assert {r.rel_path: r.mtime for r in texts.case_files(spark, str(tmp_path), whole=1000).collect()} == times


def test_a_turn_reads_its_part_only(tmp_path, monkeypatch):
    (tmp_path / "f").write_bytes(data := os.urandom(3000))
    read, opened = [], texts.opened

    class Counted:
        def __init__(self, path):
            self.f = opened(path)
            read.append(0)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            b = self.f.read(n)
            read[-1] += len(b)
            return b

    monkeypatch.setattr(texts, "opened", Counted)
    at, h = 0, b""
    while at < 3000:
        _, _, at, h = texts._went_on(f"file:{tmp_path}/f", 3000, at, h, 1300)
    assert h == hashlib.sha256(data).hexdigest() and read == [1300, 1300, 400]


def test_without_states_a_file_is_hashed_to_its_end(tmp_path, monkeypatch):
    (tmp_path / "f").write_bytes(data := os.urandom(3000))
    half = texts._went_on(f"file:{tmp_path}/f", 3000, 0, b"", 1300)
    monkeypatch.setattr(digests, "_crypto", lambda: None)
    for at, h in ((0, b""), half[2:]):
        assert texts._went_on(f"file:{tmp_path}/f", 3000, at, h, 1300)[2:] == (3000, hashlib.sha256(data).hexdigest())


def test_what_only_spark_can_open(spark, tmp_path):
    (tmp_path / "f").write_bytes(data := os.urandom(3000))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.walked.link./in", f"file://{tmp_path}")
    got = _walked(texts.case_files(spark, "viewfs://walked/in", whole=1000, turn=1300))
    assert got == {"f": (3000, hashlib.sha256(data).hexdigest())}
