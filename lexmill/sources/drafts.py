"""Drafts in Word files as numbered paragraphs with their notes: what a reader sees, not what the file stores.

A file is parsed once to paragraphs with the counters of their lists and the places of their notes' marks, both of which hang
on the order inside the file: a counter begins anew after an item of a higher level, a note's paragraphs follow the paragraph
that has its mark. The rest is done on the file's own row: how a counter is written, the reading order, the text, and
what a reader of it would miss, which is a warning row. A file with tracked changes is refused, since its text
isn't settled; so is one that can't be read.
"""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from functools import lru_cache
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import plain_udf
from ..operators.rulebooks import letters, roman
from ..session import once
from .packages import DEEPEST, MAIN, MARKS, UNSEEN, WORD, Refused, body_of, parts, root_of

NUMBERING, STYLES, FOOTNOTES, ENDNOTES = "word/numbering.xml", "word/styles.xml", "word/footnotes.xml", "word/endnotes.xml"
LEVELS = 9
#: Elements of tracked changes, and elements whose content isn't read, in words.
TRACKED = {"ins": "insertion", "del": "deletion", "moveFrom": "move", "moveTo": "move", "cellIns": "cell insertion", "cellDel": "cell deletion", "cellMerge": "cell merge"}
UNREAD = {"sym": "symbol characters", "oMath": "equations", "altChunk": "embedded content", "ruby": "phonetic guide text", "txbxContent": "text boxes"}

#: Parts of up to so many bytes, styles or lists, are remembered as read: drafts of one house share them.
SHARED = 1 << 16

#: host, k: the paragraph and the mark there that a paragraph follows (its own and -1 in the body; null for a note without a
#: mark outside of contents); cited: whether a note has a mark at all. form: how a list writes its mark, with %1 for the first
#: of counters; null without a list or for a bullet.
_PARA = "i:int,kind:string,note:string,heading:int,contents:boolean,host:int,k:int,cited:boolean,form:string,counters:array<struct<n:int,form:string>>,text:string"
READ = f"struct<reason:string,paragraphs:array<struct<{_PARA}>>,warnings:array<struct<i:int,warning:string>>>"


def _value(e: ElementTree.Element | None, name: str) -> str | None:
    child = e.find(WORD + name) if e is not None else None
    return child.get(WORD + "val") if child is not None else None


def _number(text: str | None, other: int | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"-?\d+", text) else other


class Styles:
    """Paragraph styles, each seen through those that it is based on."""

    def __init__(self, xml: bytes | None):
        self.own: dict[str | None, ElementTree.Element] = {}
        if xml is not None:
            self.own = {s.get(WORD + "styleId"): s for s in root_of(xml).findall(WORD + "style")}
        # Each style is looked up once.
        self.numbering, self.heading, self.contents = lru_cache(256)(self._numbering), lru_cache(256)(self._heading), lru_cache(256)(self._contents)

    def chain(self, style: str | None) -> list[ElementTree.Element]:
        out: list[ElementTree.Element] = []
        while style in self.own and self.own[style] not in out:
            out.append(self.own[style])
            style = _value(out[-1], "basedOn")
        return out

    def _numbering(self, style: str | None) -> tuple[str | None, int | None, str | None]:
        """(list, level, style that names them) of the nearest style of the chain that has a list."""
        for s in self.chain(style):
            n = s.find(f"{WORD}pPr/{WORD}numPr")
            if (num := _value(n, "numId")) is not None:
                return num, _number(_value(n, "ilvl"), None), s.get(WORD + "styleId")
        return None, None, None

    def _heading(self, style: str | None) -> int:
        for s in self.chain(style):
            if m := re.fullmatch(r"(?i)heading\s*([1-9])", (_value(s, "name") or s.get(WORD + "styleId") or "").strip()):
                return int(m[1])
            level = _number(_value(s.find(WORD + "pPr"), "outlineLvl"), None)
            if level is not None and level < LEVELS:
                return level + 1
        return 0

    def _contents(self, style: str | None) -> bool:
        """Whether it is a line of a table of contents or of authorities."""
        return any(re.fullmatch(r"(?i)(?:toc|index) (?:\d|heading)|table of (?:authorities|figures)|toa heading", (_value(s, "name") or "").strip()) for s in self.chain(style))


def _lists(xml: bytes | None) -> tuple[list[dict], dict[tuple[str, str], int]]:
    """A row for each level of each list, and the level that a style stands for in a list. Lists of one definition count on
    together, unless one begins a level anew."""
    if xml is None:
        return [], {}
    root = root_of(xml)
    models = {a.get(WORD + "abstractNumId"): a.findall(WORD + "lvl") for a in root.findall(WORD + "abstractNum")}
    rows, by_style = [], {}
    for n in root.findall(WORD + "num"):
        num, model = n.get(WORD + "numId"), _value(n, "abstractNumId")
        anew = {o.get(WORD + "ilvl"): _value(o, "startOverride") for o in n.findall(WORD + "lvlOverride") if _value(o, "startOverride") is not None}
        for lv in models.get(model, []):
            level = lv.get(WORD + "ilvl", "0")
            rows.append({
                "num": num, "list": f"num {num}" if anew else f"model {model}", "level": int(level), "format": _value(lv, "numFmt") or "decimal", "text": _value(lv, "lvlText") or "",
                "start": _number(anew.get(level), _number(_value(lv, "start"), 1)), "plain": lv.find(WORD + "isLgl") is not None,
            })
            if style := _value(lv, "pStyle"):
                by_style[num, style] = int(level)
    return rows, by_style


def _shared(read):
    """read of a part, remembered for parts up to ``SHARED``; what it returns isn't changed."""
    known = lru_cache(32)(read)
    return lambda xml: (known if xml is not None and len(xml) <= SHARED else read)(xml)


_styles, _numbering = _shared(Styles), _shared(_lists)


class Reader:
    def __init__(self, files: dict[str, bytes]):
        self.styles = _styles(files.get(STYLES))
        lists, self.by_style = _numbering(files.get(NUMBERING))
        self.known: dict[tuple[str, int], dict] = {}
        for r in lists:
            self.known.setdefault((r["num"], r["level"]), r)
        #: Items of each level so far, by kind and list.
        self.counts: dict[tuple[str, str], list[int]] = {}
        self.paragraphs: list[dict] = []
        self.warnings: list[dict] = []
        #: Where a note's first mark stands, and the notes that have any.
        self.first: dict[tuple[str, str], tuple[int, int]] = {}
        self.cited: set[tuple[str, str]] = set()

    def warn(self, text: str) -> None:
        row = {"i": len(self.paragraphs), "warning": text}
        if row not in self.warnings:
            self.warnings.append(row)

    def walk(self, e: ElementTree.Element, kind: str, note: str | None, depth: int = 0) -> None:
        """The paragraphs under e in reading order; tables row by row, cell by cell."""
        for c in e:
            name = c.tag.removeprefix(WORD)
            if name in TRACKED:
                raise Refused(f"tracked changes: {TRACKED[name]}")
            if name == "p":
                self.paragraph(c, kind, note)
            elif name == "tbl" and depth >= DEEPEST:
                self.warn("a table too deep to read")
            elif name in UNREAD:
                self.warn(f"not read: {UNREAD[name]}")
            elif name not in ("sectPr", "tblPr", "tblGrid", "trPr", "tcPr", "sdtPr"):
                self.walk(c, kind, note, depth + (name == "tbl"))

    def paragraph(self, p: ElementTree.Element, kind: str, note: str | None) -> None:
        own = p.find(WORD + "pPr")
        style = _value(own, "pStyle")
        n = own.find(WORD + "numPr") if own is not None else None
        num, level = _value(n, "numId"), _number(_value(n, "ilvl"), None)
        if num is None:
            num, by, named = self.styles.numbering(style)
            level = level if level is not None else by if by is not None else self.by_style.get((num, named))
        num = None if num == "0" else num
        level = (level or 0) if num is not None else None
        if num is not None and (num, level) not in self.known:
            self.warn(f"list {num} has no level {level + 1}: its number isn't shown")
            num = level = None
        seen: list[str] = []
        marks: list[tuple[str, str]] = []
        todo = list(reversed(p))
        while todo:
            e = todo.pop()
            name = e.tag.rpartition("}")[2]
            if name in TRACKED:
                raise Refused(f"tracked changes: {TRACKED[name]}")
            if name == "r" and e.find(f"{WORD}rPr/{WORD}vanish") is not None:
                self.warn("hidden text")
            elif name in ("footnoteReference", "endnoteReference"):
                marks.append((name.removesuffix("Reference"), e.get(WORD + "id")))
            elif name in UNREAD:
                self.warn(f"not read: {UNREAD[name]}")
            elif name == "t":
                seen.append(e.text or "")
            elif name in MARKS:
                seen.append(MARKS[name])
            elif name not in UNSEEN:
                todo.extend(reversed(e))
        form, counters = self.mark(kind, num, level) if num is not None else (None, None)
        contents, i = self.styles.contents(style), len(self.paragraphs)
        host, k = (i, -1) if kind == "body" else self.first.get((kind, note), (None, None))
        if kind == "body":
            for n, m in enumerate(marks):
                if m[1] is not None:
                    self.cited.add(m)
                    if not contents:
                        self.first.setdefault(m, (i, n))
        outline = _number(_value(own, "outlineLvl"), None)
        heading = outline + 1 if outline is not None and outline < LEVELS else self.styles.heading(style)
        self.paragraphs.append({
            "i": i, "kind": kind, "note": note, "heading": heading, "contents": contents, "host": host, "k": k, "cited": (kind, note) in self.cited, "form": form, "counters": counters,
            "text": "".join(seen),
        })

    def mark(self, kind: str, num: str, level: int) -> tuple[str | None, list[dict] | None]:
        """How a list writes its next item's mark, and the counters in it. A level counts on from its last item, and begins
        anew after an item of a level above it; notes count apart from the body."""
        own = self.known[num, level]
        counts = self.counts.setdefault((kind, own["list"]), [0] * LEVELS)
        for j in range(LEVELS):
            counts[j] = counts[j] + 1 if j == level else counts[j] if j < level else 0
        if own["format"] in ("bullet", "none"):
            return None, None
        out = []
        for j in range(LEVELS):
            one = self.known.get((num, j), {"start": 1, "format": "decimal"})
            out.append({"n": one["start"] + max(counts[j] - 1, 0), "form": "decimal" if own["plain"] else one["format"]})
        return own["text"], out


def read_word(raw: bytes | None) -> dict:
    """What ``READ`` says of a file: its body's paragraphs, then those of each note; null parts with a reason if refused."""
    try:
        if raw is None:
            raise Refused("no file")
        files = parts(bytes(raw), (NUMBERING, STYLES, FOOTNOTES, ENDNOTES))
        r = Reader(files)
        r.walk(body_of(files[MAIN]), "body", None)
        for part, kind in ((FOOTNOTES, "footnote"), (ENDNOTES, "endnote")):
            for note in root_of(files[part]) if part in files else ():
                if note.tag == WORD + kind and note.get(WORD + "type") in (None, "normal"):
                    r.walk(note, kind, note.get(WORD + "id"))
        return {"reason": None, "paragraphs": r.paragraphs, "warnings": r.warnings}
    except Refused as e:
        return {"reason": str(e), "paragraphs": [], "warnings": []}
    except (zipfile.BadZipFile, zlib.error, struct.error, EOFError, RuntimeError, NotImplementedError, OSError):
        return {"reason": "corrupt archive", "paragraphs": [], "warnings": []}


def parsed(files: DataFrame, by: str, content: str = "content", deal: bool = True) -> DataFrame:
    """by and ``read``, the parse of each file; read by the functions below. ``deal``: files are dealt to tasks first, which
    a caller leaves out who has dealt what they are made of."""
    # A table of small files is one task's input otherwise.
    own = files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(by)) if deal else files
    return once(own.select(by, plain_udf(read_word, READ)(content).alias("_r")), read=F.col("_r")).select(by, "read")


def _shown(n: Column, form: Column) -> Column:
    """A counter as its list writes it; a form without a rule here is written as a number."""
    small = (n >= 1) & (n <= 199)
    return (
        F.when((form == "upperRoman") & small, F.upper(roman(n))).when((form == "lowerRoman") & small, roman(n)).when((form == "upperLetter") & (n >= 1), F.upper(letters(n)))
        .when((form == "lowerLetter") & (n >= 1), letters(n)).when(form == "decimalZero", F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
    )


def _mark(p: Column) -> Column:
    """The number or letter that a paragraph of a list shows, bullets none."""
    shown = F.transform(p["counters"], lambda x: _shown(x["n"], x["form"]))
    # The numbers are written once, then put into the form.
    text = F.aggregate(shown, F.struct(p["form"].alias("t"), F.lit(1).alias("j")), lambda a, x: F.struct(F.replace(a["t"], F.concat(F.lit("%"), a["j"].cast("string")), x).alias("t"), (a["j"] + 1).alias("j")))["t"]
    return F.nullif(F.trim(text), F.lit(""))


def _rows(read: DataFrame, by: str) -> DataFrame:
    """by, rows: the paragraphs of drafts in reading order (host, k, i, flow, heading, text), see ``draft_paragraphs``."""
    placed = F.filter("read.paragraphs", lambda p: p["host"].isNotNull() & ((p["kind"] != "body") | ~p["contents"]))
    body = lambda p: p["kind"] == "body"
    row = lambda p: F.struct(
        p["host"].alias("host"), p["k"].alias("k"), p["i"].alias("i"), F.when(body(p), "body").otherwise("note").alias("flow"), F.when(body(p), p["heading"]).otherwise(0).alias("heading"),
        F.concat_ws(" ", F.when(p["form"].isNotNull(), _mark(p)), p["text"]).alias("text"),
    )
    return once(read, rows=F.sort_array(F.filter(F.transform(placed, row), lambda r: F.trim(r["text"]) != ""))).select(by, "rows")


def draft_paragraphs(read: DataFrame, by: str) -> DataFrame:
    """by, place, flow, heading, text: the paragraphs of drafts in reading order, each with its list's mark in front; a note's
    come right after the paragraph that has its mark, in the order of the marks (a note with two marks stands at the first).
    Lines of tables of contents and paragraphs without text are left out."""
    rows = _rows(read, by).select(by, F.posexplode("rows").alias("_i", "_r"))
    return rows.select(by, (F.col("_i") + 1).alias("place"), "_r.flow", "_r.heading", "_r.text")


def draft_warnings(read: DataFrame, by: str) -> DataFrame:
    """by, warning, n: why a draft wasn't read, what in it wasn't, notes without a mark, and lines of contents left out."""
    lost = F.size(F.array_distinct(F.transform(F.filter("read.paragraphs", lambda p: (p["kind"] != "body") & ~p["cited"]), lambda p: F.struct(p["kind"], p["note"]))))
    left = F.size(F.filter("read.paragraphs", lambda p: p["contents"]))
    refused = F.when(F.col("read.reason").isNotNull(), F.array(F.concat(F.lit("refused: "), "read.reason"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(refused, F.col("read.warnings.warning"), F.array_repeat(F.lit("a note without a mark"), lost), F.array_repeat(F.lit("a line of contents left out"), left))
    return once(read, _w=every).select(by, F.explode("_w").alias("warning")).groupBy(by, "warning").agg(F.count("*").alias("n"))


def draft_texts(read: DataFrame, by: str) -> DataFrame:
    """by, text: each draft as text for the brief check: headings with '#', notes marked as such, blank lines between."""
    line = lambda r: F.when(r["heading"] > 0, F.concat(F.repeat(F.lit("#"), F.least(r["heading"], F.lit(6))), F.lit(" "), r["text"])).when(r["flow"] == "note", F.concat(F.lit("[^n]: "), r["text"])).otherwise(r["text"])
    return once(_rows(read, by).where(F.size("rows") > 0), text=F.array_join(F.transform("rows", line), "\n\n")).select(by, "text")
