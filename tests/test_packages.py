"""Word and PDF files, diffs: cases by hand."""

import io
import struct
import zipfile

from pyspark.sql import functions as F

from lexmill.operators import diffs, scoring
from lexmill.sources import packages as P

NS = P.WORD[1:-1]


def word(body: str, names=(P.MAIN,), head: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, f'{head}<w:document xmlns:w="{NS}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_word_blocks_nested_table():
    p = lambda s: f"<w:p><w:r><w:t>{s}</w:t></w:r></w:p>"
    inner = f"<w:tbl><w:tblPr/><w:tr><w:tc>{p('deep')}</w:tc></w:tr></w:tbl>"
    body = f"{p('one')}<w:tbl><w:tblGrid/><w:tr><w:trPr/><w:tc>{p('c')}{inner}</w:tc><w:tc>{p('d')}</w:tc></w:tr></w:tbl><w:p><w:r><w:t>x</w:t><w:br/><w:noBreakHyphen/><w:softHyphen/></w:r></w:p>"
    why, got = P.word_blocks(word(body))
    assert why is None
    assert [(b[0], b[4]) for b in got] == [([0], "one"), ([1, 0, 0, 0], "c"), ([1, 0, 0, 1, 0, 0, 0], "deep"), ([1, 0, 1, 0], "d"), ([2], "x\n-")]
    full = "\n".join(b[4] for b in got)
    assert all(full[b[1] : b[2]] == b[4] for b in got)


def test_word_refusals():
    good = word("<w:p/>")
    end = good.rfind(b"PK\x05\x06")
    many = good[: end + 8] + struct.pack("<HH", 20000, 20000) + good[end + 12 :]
    lie = good[: end + 8] + struct.pack("<HH", 2, 2) + good[end + 12 :]
    wide = good[: end + 12] + struct.pack("<I", 1 << 30) + good[end + 16 :]
    cases = {
        None: "no file", b"": "not a zip archive", b"%PDF-": "not a zip archive", good[:end]: "corrupt archive: no end of its directory", many: "size_limit:members", lie: "corrupt archive: more members than its directory holds", good + b"x": "corrupt archive: no end of its directory",
        wide: "size_limit:central_directory", word("", ("a",)): f"0 parts {P.MAIN}", word("<w:p>"): "malformed xml", word("", head="<!-- x --><!DOCTYPE a>"): "document type declaration",
    }
    for raw, why in cases.items():
        assert P.word_blocks(raw) == (why, []), why
    assert P.word_blocks(good) == (None, [([0], 0, 0, 0, "")])
    flipped = bytearray(word("<w:p/>" * 50))
    flipped[60:90] = bytes(30)
    assert P.word_blocks(bytes(flipped))[0] is not None


def test_pdf_strings():
    assert P._shown(rb"(a\(b\)\\ \101\12c(n(e)st)) Tj [(x) 3 (y)] TJ (z) ' % (gone) Tj") == "a(b)\\ A\nc(n(e)st)\nxyz\n"
    assert P._shown(b"(open") == "open"
    assert P.pdf_text(None) == ("no file", None, []) and P.pdf_text(b"") == ("no text stream that can be decoded", None, [])
    two = b"1 0 obj << /Type /Pages /Count 4 /Parent 9 0 R >> endobj 2 0 obj << /Type /Pages /Count 2 >> endobj 3 0 obj << /Pages 2 0 R /Type /Catalog >> endobj "
    assert P.pdf_text(two)[1] == 2 and P.pdf_text(two + b"4 0 obj << /Pages 1 0 R >> endobj trailer << /Root 4 0 R >>")[1] == 4
    assert P.pdf_text(b"1 0 obj << /Type /Pages /Count 4 >> endobj")[1] is None


def test_readers_on_empty_tables(spark):
    none = spark.createDataFrame([], "id int, content binary")
    assert P.docx_blocks(none, ["id"]).count() == P.pdf_pages(none, ["id"]).count() == 0
    row = spark.createDataFrame([(1, None)], "id int, content binary")
    assert [r.reason for r in P.docx_blocks(row, ["id"]).collect()] == [r.reason for r in P.pdf_pages(row, ["id"]).collect()] == ["no file"]


def test_added_lines(spark):
    text = "diff --git a/q b/q\n--- a/q\n+++ b/q\n@@ -0,0 +1 @@\n+one\n@@ -5 +6,2 @@ f\n-x\n+++ y\n z\n--- a/r\n+++ /dev/null\n@@ -1 +0,0 @@\n-gone\ndiff --cc s\n+++ b/s\n@@@ -1,2 -1,2 +1,3 @@@\n  both\n+ mine\n +theirs\n--out"
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"))], "c int, line_no int, line string")
    got = sorted(tuple(r) for r in diffs.added_lines(d, ["c"]).collect())
    assert got == [(1, "q", 1, "one"), (1, "q", 6, "++ y"), (1, "s", 2, "mine"), (1, "s", 3, "theirs")]
    assert diffs.added_lines(d.where("false"), ["c"]).count() == 0


def test_pollution_equals_all_pairs(spark):
    words = ["a", "ab", "bab", "", "abab", None]
    gold = spark.range(60).select(F.col("id").alias("item_id"), (F.col("id") % 3).alias("doc"), (F.col("id") % 7).alias("start"), (F.col("id") % 5).alias("end"), F.array(*map(F.lit, words))[(F.col("id") % 6).cast("int")].alias("text"))
    preds = gold.select((F.col("item_id") + 100).alias("pred_id"), "doc", (F.col("start") + F.col("item_id") % 2).alias("start"), "end", F.concat("text", F.lit("ab")).alias("text"))
    g = gold.select("doc", "item_id", F.col("text").alias("t"), F.col("start").alias("s"), F.col("end").alias("e"))
    want = preds.join(g, "doc").where("contains(text, t) and (start <> s or end <> e)").groupBy("pred_id").agg(F.min("item_id").alias("item_id"))
    assert sorted(tuple(r) for r in scoring.pollution(gold, preds).collect()) == sorted(tuple(r) for r in want.collect())
