"""Word drafts with lists, notes and styles, composed from keys: every customer's is one."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import brief
from ..session import dealt, table
from ..sources import drafts as D
from ..sources.packages import MAIN, WORD
from .registry import query

_NS = f'xmlns:w="{WORD[1:-1]}"'


def _p(text: str, num: int | None = None, level: int | None = None, style: str = "", inner: str = "") -> str:
    listed = f'<w:numPr>{"" if level is None else f"<w:ilvl w:val='{level}'/>"}<w:numId w:val="{num}"/></w:numPr>' if num is not None else ""
    styled = f'<w:pStyle w:val="{style}"/>' if style else ""
    return f'<w:p><w:pPr>{styled}{listed}</w:pPr><w:r><w:t xml:space="preserve">{text}</w:t></w:r>{inner}</w:p>'


def _mark(kind: str, note: int) -> str:
    return f'<w:r><w:{kind}Reference w:id="{note}"/></w:r>'


_LEVELS = [("upperRoman", "%1."), ("upperLetter", "%2."), ("decimal", "%1.%2.%3"), ("lowerLetter", "(%4)"), ("bullet", "*")]
_NUMBERING = (
    f'<w:numbering {_NS}><w:abstractNum w:abstractNumId="0">'
    + "".join(f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="{f}"/>{"<w:isLgl/>" if i == 2 else ""}{"<w:pStyle w:val=\'Point\'/>" if i == 1 else ""}<w:lvlText w:val="{t}"/></w:lvl>' for i, (f, t) in enumerate(_LEVELS))
    + '</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="0"/></w:num>'
    + '<w:num w:numId="3"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num></w:numbering>'
)
_STYLES = (
    f'<w:styles {_NS}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="Own"><w:name w:val="Own"/><w:basedOn w:val="H1"/></w:style><w:style w:styleId="T1"><w:name w:val="toc 1"/></w:style>'
    '<w:style w:styleId="Point"><w:name w:val="Point"/><w:pPr><w:numPr><w:numId w:val="1"/></w:numPr></w:pPr></w:style><w:style w:styleId="Sub"><w:name w:val="Sub"/><w:basedOn w:val="Point"/></w:style></w:styles>'
)
_FOOTNOTES = f'<w:footnotes {_NS}><w:footnote w:type="separator" w:id="0">{_p("-")}</w:footnote><w:footnote w:id="1">{_p("First note, ECF No. 4.", 1, 0)}{_p("goes on")}</w:footnote><w:footnote w:id="2">{_p("Id. at 3.")}</w:footnote><w:footnote w:id="9">{_p("lost")}</w:footnote></w:footnotes>'
_ENDNOTES = f'<w:endnotes {_NS}><w:endnote w:id="1">{_p("End note.")}</w:endnote></w:endnotes>'

#: Paragraphs of the draft ("@" is the key) and what they show: (flow, heading, text), null if they are left out.
_DRAFT: list[tuple[str, list[tuple[str, int, str]]]] = [
    (_p("Contents ... 1", style="T1"), []),
    (_p("Facts", 1, 0, "Own"), [("body", 1, "I. Facts")]),
    (_p("He came @.", 1, 1, inner=_mark("footnote", 1) + _mark("endnote", 1)), [("body", 0, "A. He came @."), ("note", 0, "I. First note, ECF No. 4."), ("note", 0, "goes on"), ("note", 0, "End note.")]),
    (_p("He sat.", style="Sub"), [("body", 0, "B. He sat.")]),
    (_p("He spoke.", 1, 2), [("body", 0, "1.2.1 He spoke.")]),
    (_p("He went on.", 2, 2), [("body", 0, "1.2.2 He went on.")]),
    (_p("aside", 1, 3), [("body", 0, "(a) aside")]),
    (_p("point", 1, 4), [("body", 0, "point")]),
    (_p("Law", 1, 0, "H1"), [("body", 1, "II. Law")]),
    (_p("It is so.", 1, 1, inner=_mark("footnote", 2)), [("body", 0, "A. It is so."), ("note", 0, "Id. at 3.")]),
    (_p("plain", 0, 0), [("body", 0, "plain")]),
    (_p("Anew", 3, 0), [("body", 0, "V. Anew")]),
    (_p("no list", 7, 0), [("body", 0, "no list")]),
    ('<w:p><w:r><w:rPr><w:vanish/></w:rPr><w:t>hidden</w:t></w:r><w:r><w:t>seen</w:t></w:r></w:p><w:tbl><w:tr><w:tc>' + _p("cell", 3, 0) + "</w:tc></w:tr></w:tbl>", [("body", 0, "seen"), ("body", 0, "VI. cell")]),
    ("<w:p/>", []),
]


def _file(key: int) -> bytes:
    body = "".join(p for p, _ in _DRAFT).replace("@", str(key))
    if key % 10 == 1:
        body += f"<w:p><w:ins><w:r><w:t>{key}</w:t></w:r></w:ins></w:p>"
    if key % 10 == 2:
        body += "<w:p><w:r><w:sym/></w:r></w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in ((MAIN, f"<w:document {_NS}><w:body>{body}</w:body></w:document>"), (D.NUMBERING, _NUMBERING), (D.STYLES, _STYLES), (D.FOOTNOTES, _FOOTNOTES), (D.ENDNOTES, _ENDNOTES)):
            z.writestr(name, xml)
    return out.getvalue()


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.udf(_file, "binary", useArrow=True)
    # Keys are dealt before files are made of them, not the files.
    keys = dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
    return D.parsed(keys.select("c_custkey", made("c_custkey").alias("content")), "c_custkey", deal=False)


_SHOWN = [row for _, rows in _DRAFT for row in rows]
_VALUES = ", ".join(f"({i}, '{flow}', {heading}, '{text}')" for i, (flow, heading, text) in enumerate(_SHOWN, 1))


@query(f"SELECT c_custkey, CAST(i AS INTEGER) AS place, flow, h AS heading, replace(t, '@', CAST(c_custkey AS VARCHAR)) AS text FROM customer, (VALUES {_VALUES}) v(i, flow, h, t) WHERE c_custkey % 10 <> 1")
def word_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of Word drafts with the numbers that their lists show and their notes after the paragraph that cites them."""
    return D.draft_paragraphs(_read(spark, sf_dir), "c_custkey")


@query("""
SELECT c_custkey, w AS warning, CAST(1 AS BIGINT) AS n FROM customer, (VALUES ('list 7 has no level 1: its number isn''t shown'), ('hidden text'), ('a note without a mark'), ('a line of contents left out')) t(w) WHERE c_custkey % 10 <> 1
UNION ALL SELECT c_custkey, CASE c_custkey % 10 WHEN 1 THEN 'refused: tracked changes: insertion' ELSE 'not read: symbol characters' END, 1 FROM customer WHERE c_custkey % 10 IN (1, 2)
""")
def word_draft_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why drafts weren't read, and what in them wasn't."""
    return D.draft_warnings(_read(spark, sf_dir), "c_custkey")


@query("SELECT CAST(c_custkey AS VARCHAR) AS draft_id, raw, target FROM customer, (VALUES ('ECF No. 4', '4'), ('Id. at 3', '4')) t(raw, target) WHERE c_custkey % 10 <> 1")
def word_draft_cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cites of Word drafts: an 'Id.' in a note stands for the note before it."""
    text = D.draft_texts(_read(spark, sf_dir), "c_custkey")
    b = brief.bound(brief.cites(brief.units(text.select(F.col("c_custkey").alias("draft_id"), F.lit("c").alias("case_id"), "text"))))
    return b.select("draft_id", "raw", "target")
