"""Queries over Word and PDF files and diffs, composed from keys and texts, so that truth is arithmetic."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diffs, leaks
from ..session import table
from ..sources import packages as P
from .registry import query


def _word_file(key: int, text: str) -> bytes:
    """A Word file of a head, a table of two cells and a text beside a deleted one; other kinds for some keys."""
    p = lambda inner: f"<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r>{inner}</w:r></w:p>"
    t = lambda s: '<w:t xml:space="preserve">' + escape(s, {"\r": "&#13;"}) + "</w:t>"
    cells = f"<w:tc><w:tcPr/>{p(t(f'a{key}'))}</w:tc><w:tc>{p(t('b') + '<w:tab/>' + t(str(key)))}</w:tc>"
    last = f"<w:p><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins><w:r>{t(text)}</w:r></w:ins></w:p>"
    body = "" if key % 11 == 3 else f"{p(t(f'Head {key}'))}<w:bookmarkStart/><w:tbl><w:tr>{cells}</w:tr></w:tbl>{last}<w:sectPr/>"
    xml = f'<w:document xmlns:w="{P.WORD[1:-1]}"><w:body>{body}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        if key % 11 != 2:
            z.writestr(P.MAIN, ("<?xml version='1.0'?><!DOCTYPE x>" if key % 11 == 1 else "") + xml)
    return out.getvalue() if key % 11 else b"plain " + out.getvalue()


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}]', '', 'g') AS t, doc_id % 11 AS m, length(CAST(doc_id AS VARCHAR)) AS k FROM documents),
b AS (
  SELECT doc_id, 0 AS block_index, 'b0' AS l, 'paragraph' AS container, 0 AS char_start, 'Head ' || doc_id AS t FROM d WHERE m > 3
  UNION ALL SELECT doc_id, 1, 'b1/r0/c0/b0', 'table-cell', 6 + k, 'a' || doc_id FROM d WHERE m > 3
  UNION ALL SELECT doc_id, 2, 'b1/r0/c1/b0', 'table-cell', 8 + 2 * k, 'b' || chr(9) || doc_id FROM d WHERE m > 3
  UNION ALL SELECT doc_id, 3, 'b2', 'paragraph', 11 + 3 * k, t FROM d WHERE m > 3)
SELECT doc_id, block_index, 'word/document.xml#' || l AS locator, container, char_start, char_start + length(t) AS char_end, sha256(t) AS text_sha256, 'extracted' AS status, NULL AS reason FROM b
UNION ALL SELECT doc_id, -1, 'word/document.xml#', 'part', CASE m WHEN 3 THEN 0 END, CASE m WHEN 3 THEN 0 END, CASE m WHEN 3 THEN sha256('') END,
  CASE m WHEN 3 THEN 'extracted' ELSE 'extraction-failed' END, CASE m WHEN 0 THEN 'not a zip archive' WHEN 1 THEN 'document type declaration' WHEN 2 THEN '0 parts word/document.xml' ELSE 'no paragraphs' END FROM d WHERE m <= 3
""")
def docx_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of composed Word files, each with a document's whole text, and the refused ones."""
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")
    made = F.udf(_word_file, "binary", useArrow=True)
    files = table(spark, sf_dir, "documents").select("doc_id", made("doc_id", clean).alias("content"))
    return P.docx_blocks(files, ["doc_id"]).drop("path", "runs", "text")


def _pdf_file(key: int) -> bytes:
    """A PDF file of one to three pages, its page tree in the open or within an object stream; every seventh is not
    compressed and so has no text to read."""
    n, plain = 1 + key % 3, key % 7 == 0
    out = [b"%PDF-1.5\n"]
    pages, catalog = b"<< /Type /Pages /Kids [2 0 R] /Count %d >>" % n, b"<< /Type /Catalog /Pages 90 0 R >>"
    other = b"<< /Type /Pages /Count 99 >>"  # a tree that no catalog names
    if key % 2:  # packed: numbers and places, then the objects
        packed = [(90, pages), (91, catalog), (92, other)]
        places = [sum(len(x) + 1 for _, x in packed[:i]) for i in range(3)]
        head = b" ".join(b"%d %d" % (k, at) for (k, _), at in zip(packed, places, strict=True)) + b" "
        tree = zlib.compress(head + b" ".join(x for _, x in packed))
        out.append(b"1 0 obj\n<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode >>\nstream\n" % len(head) + tree + b"\nendstream\nendobj\n")
    else:
        out.append(b"90 0 obj\n" + pages + b"\nendobj\n91 0 obj\n" + catalog + b"\nendobj\n92 0 obj\n" + other + b"\nendobj\n")
    for i in range(1, n + 1):
        shown = b"BT /F1 12 Tf %% (no) Tj\n(Page %d of \\%03o) Tj [(%d(x)) -20 (y\\)z)] TJ <41> Tj ET" % (i, 65, key)
        body = shown if plain else zlib.compress(shown)
        out.append(b"%d 0 obj\n<< %s >>\nstream\n" % (i + 2, b"" if plain else b"/Filter /FlateDecode") + body + b"\nendstream\nendobj\n")
    out.append(b"trailer\n<< /Size 93 /Root 91 0 R >>\nstartxref\n0\n%%EOF\n")
    return b"".join(out)


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 7 = 0 AS bad, CAST(1 + c_custkey % 3 AS INTEGER) AS n_pages FROM customer)
SELECT c_custkey, i AS page_number, n_pages, CASE WHEN bad THEN '' ELSE 'Page ' || i || ' of A' || chr(10) || c_custkey || '(x)y)z' || chr(10) END AS text,
  CASE WHEN bad THEN 'extraction-failed' ELSE 'extracted' END AS status, CASE WHEN bad THEN 'no text stream that can be decoded' END AS reason
FROM c, (VALUES (1), (2), (3)) v(i) WHERE i <= CASE WHEN bad THEN 1 ELSE n_pages END
""")
def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of composed PDF files."""
    made = F.udf(_pdf_file, "binary", useArrow=True)
    return P.pdf_pages(table(spark, sf_dir, "customer").select("c_custkey", made("c_custkey").alias("content")), ["c_custkey"]).drop("text_sha256")


@query("""
SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'docx' WHEN 2 THEN 'pdf' WHEN 7 THEN 'text' END AS reader,
  CASE c_custkey % 8 WHEN 1 THEN 'not a zip archive' WHEN 3 THEN 'not a PDF' WHEN 4 THEN 'unsupported format' WHEN 5 THEN 'an archive under a text name' WHEN 6 THEN 'a PDF under a text name' END AS refusal
FROM customer
""")
def draft_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How drafts are read, by name and first bytes."""
    m = F.col("c_custkey") % 8
    name = F.when(m <= 1, "Brief.DOCX").when(m <= 3, "a.b/brief.pdf").when(m == 4, "old.doc").when(m == 5, "x.md").when(m == 6, "x.txt").otherwise("a.b/README")
    content = F.when(m.isin(0, 5), F.unhex(F.lit("504B03040A"))).when(m.isin(2, 6), F.encode(F.lit("%PDF-1.7"), "UTF-8")).otherwise(F.encode(F.lit("text"), "UTF-8"))
    return table(spark, sf_dir, "customer").select("c_custkey", P.draft_kind(name, content).alias("_d")).select("c_custkey", "_d.*")


def _diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff for each order: two files, a line that looks like a file's head, and a combined hunk."""
    k = F.col("o_orderkey")
    second = F.when(k % 3 == 0, F.concat(F.lit('+++ "b/caf\\303\\251\\\\'), (k % 5).cast("string"), F.lit('"'))).otherwise(F.concat(F.lit("+++ b/f"), k.cast("string")))
    text = [
        F.lit("diff --git a/x b/x"), F.lit("--- a/x"), second, F.concat(F.lit("@@ -1,2 +"), (k % 7 + 10).cast("string"), F.lit(",3 @@ part")), F.lit(" kept"), F.lit("-gone"), F.concat(F.lit("+++ alike"), k.cast("string")),
        F.concat(F.lit("+kim"), F.col("o_custkey").cast("string"), F.lit("@law.org")), F.lit("\\ No newline at end of file"), F.lit("--- a/y"), F.lit("+++ b/second.md\t2026"), F.lit("@@@ -1 -1 +5 @@@"), F.concat(F.lit("++merged"), k.cast("string")),
    ]
    return table(spark, sf_dir, "orders").select(k, F.posexplode(F.array(*text)).alias("line_no", "line"))


@query(r"""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'café\' || (o_orderkey % 5) ELSE 'f' || o_orderkey END AS path, CAST(o_orderkey % 7 AS INTEGER) AS m, o_custkey FROM orders)
SELECT o_orderkey, path, 11 + m AS new_line, '++ alike' || o_orderkey AS text FROM o UNION ALL SELECT o_orderkey, path, 12 + m, 'kim' || o_custkey || '@law.org' FROM o
UNION ALL SELECT o_orderkey, 'second.md', 5, 'merged' || o_orderkey FROM o
""")
def diff_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that diffs add, with their file and line number there."""
    return diffs.added_lines(_diff_lines(spark, sf_dir), ["o_orderkey"])


@query(r"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'café\' || (o_orderkey % 5) ELSE 'f' || o_orderkey END AS path, CAST(12 + o_orderkey % 7 AS INTEGER) AS new_line, 'email' AS kind, 'kim' || o_custkey || '@law.org' AS detail FROM orders")
def leak_scan_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What added lines leak."""
    return leaks.scan(diffs.added_lines(_diff_lines(spark, sf_dir), ["o_orderkey"]), "text", ["o_orderkey", "path", "new_line"]).drop("line_no")


@query(r"""
WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line FROM pages),
m AS (SELECT page_id, 'email' AS kind, unnest(regexp_extract_all(line, '[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}')) AS detail FROM l WHERE line NOT LIKE '%leak-scan: allow%')
SELECT page_id, kind, detail, count(*) AS n FROM m WHERE lower(split_part(detail, '@', 2)) NOT IN ('example.com', 'example.org', 'example.net', 'example.edu')
  AND lower(regexp_extract(detail, '\.([A-Za-z]+)$', 1)) NOT IN ('example', 'invalid', 'test', 'localhost', 'txt', 'py', 'md', 'json', 'pdf', 'html', 'csv')
  AND lower(split_part(detail, '@', 1)) NOT IN ('noreply', 'no-reply', 'donotreply', 'do-not-reply') GROUP BY 1, 2, 3
UNION ALL SELECT page_id, 'home-path', NULL, count(*) FROM l WHERE regexp_matches(line, '(^|[^\w.~-])(/Users/|/home/)[A-Za-z0-9]') GROUP BY 1
""")
def leak_scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages leak."""
    found = leaks.scan(table(spark, sf_dir, "pages"), "html", ["page_id"])
    detail = F.when(F.col("kind") == "email", F.col("detail")).alias("detail")
    return found.groupBy("page_id", "kind", detail).agg(F.count("*").alias("n"))
