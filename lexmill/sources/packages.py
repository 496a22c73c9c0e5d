"""Word and PDF files (binaryFile's content) as rows. A file is parsed where it lies; what can't be read is a row with
its reason, never a failed task. A null content is refused as no file."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The format's namespace and main part, marks of file kinds, and the limits of an archive.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAIN = "word/document.xml"
ZIP_MARKS = (b"PK\x03\x04", b"PK\x05\x06")
OLE_MARK = "D0CF11E0A1B11AE1"
MOST_MEMBERS, MOST_DIRECTORY, MOST_PART, MOST_TOTAL, DEEPEST = 10_000, 32 << 20, 32 << 20, 256 << 20, 24
UNSEEN = "pPr rPr del moveFrom instrText delText delInstrText fldChar softHyphen".split()
MARKS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}


class Refused(Exception):
    """Why a file isn't read."""


def _directory(raw: bytes) -> int:
    """Members that the archive's tail declares, its bounds checked before anything is opened. The tail is the last one whose
    comment ends with the file; a field that is full is told by the 64-bit record, which ends where its locator begins."""
    at = raw.rfind(b"PK\x05\x06", max(0, len(raw) - 22 - 0xFFFF))
    while at >= 0 and (at + 22 > len(raw) or at + 22 + struct.unpack_from("<H", raw, at + 20)[0] != len(raw)):
        at = raw.rfind(b"PK\x05\x06", max(0, len(raw) - 22 - 0xFFFF), at + 3)
    if at < 0:
        raise Refused("corrupt archive: no end of its directory")
    members, size, offset = struct.unpack("<10xHII", raw[at : at + 20])
    if members == 0xFFFF or 0xFFFFFFFF in (size, offset):
        if raw[at - 20 : at - 16] != b"PK\x06\x07":
            raise Refused("corrupt archive: 64-bit sizes without a 64-bit directory")
        far = struct.unpack("<Q", raw[at - 12 : at - 4])[0]
        if raw[far : far + 4] != b"PK\x06\x06" or far + 56 > at or far + 12 + struct.unpack_from("<Q", raw, far + 4)[0] != at - 20:
            raise Refused("corrupt archive: its 64-bit directory isn't where it says")
        wide = struct.unpack("<QQQ", raw[far + 32 : far + 56])
        members, size, offset = (w if n == full else n for n, w, full in zip((members, size, offset), wide, (0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF), strict=True))
    if members > MOST_MEMBERS:
        raise Refused("size_limit:members")
    if size > MOST_DIRECTORY:
        raise Refused("size_limit:central_directory")
    if offset + size > at:
        raise Refused("corrupt archive: its directory passes its end")
    if members * 46 > size:
        raise Refused("corrupt archive: more members than its directory holds")
    return members


def parts(raw: bytes, optional: tuple[str, ...] = ()) -> dict[str, bytes]:
    """The main part of a Word file, and those of the optional ones that it has."""
    if raw[:4] not in ZIP_MARKS:
        raise Refused("not a zip archive")
    declared = _directory(raw)
    out: dict[str, bytes] = {}
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        infos = z.infolist()
        if len(infos) != declared:
            raise Refused("corrupt archive: its tail and its directory differ")
        if sum(i.file_size for i in infos) > MOST_TOTAL:
            raise Refused("size_limit:aggregate")
        for name in (MAIN, *optional):
            found = [i for i in infos if i.filename == name]
            if len(found) > 1 or (name == MAIN and not found):
                raise Refused(f"{len(found)} parts {name}")
            for info in found:
                if info.flag_bits & 1:
                    raise Refused("encrypted")
                with z.open(info) as f:
                    out[name] = f.read(MOST_PART + 1)
                if max(len(out[name]), info.file_size) > MOST_PART:
                    raise Refused("size_limit:part")
    return out


def root_of(xml: bytes) -> ElementTree.Element:
    """The root of a part in UTF-8 without a document type, which is told before any entity could be read."""
    head = xml.removeprefix(b"\xef\xbb\xbf").lstrip()
    if not head:
        raise Refused("empty part")
    if head[:1] != b"<" or b"\0" in head[:4]:
        raise Refused("unsupported encoding")
    before_root = re.match(rb"(?:\s+|<\?.*?\?>|<!--.*?-->)*", head, re.S).end()
    if head[before_root : before_root + 2] == b"<!":
        raise Refused("document type declaration")
    try:
        return ElementTree.fromstring(xml)
    except (ElementTree.ParseError, ValueError, LookupError):
        raise Refused("malformed xml") from None


def body_of(xml: bytes) -> ElementTree.Element:
    """The body of a Word file's main part."""
    root = root_of(xml)
    if root.tag != WORD + "document":
        raise Refused("not a word document")
    body = root.find(WORD + "body")
    if body is None:
        raise Refused("no body")
    return body


def _paragraph(p: ElementTree.Element) -> tuple[str, int]:
    """What a reader sees of a paragraph, and its runs."""
    seen, runs, todo = [], 0, [p]
    while todo:
        e = todo.pop()
        name = e.tag.removeprefix(WORD)
        runs += name == "r"
        if name == "t":
            seen.append(e.text or "")
        elif name in MARKS:
            seen.append(MARKS[name])
        elif e is p or name not in UNSEEN:
            todo.extend(reversed(e))
    return "".join(seen), runs


def _children(e: ElementTree.Element, names: str) -> list[ElementTree.Element]:
    return [c for c in e if c.tag in [WORD + n for n in names.split()]]


def word_blocks(raw: bytes | None) -> tuple[str | None, list]:
    """(reason, blocks): each block (path, start, end, runs, text) in reading order, a path being a body index and, in
    tables, row, cell and index again. Starts count the line breaks that join the blocks."""
    try:
        if raw is None:
            raise Refused("no file")
        todo = [((), e, 0) for e in reversed([body_of(parts(bytes(raw))[MAIN])])]
        found = []
        while todo:
            path, e, depth = todo.pop()
            if e.tag == WORD + "p":
                found.append((path, *_paragraph(e)))
            elif e.tag == WORD + "tbl":
                if depth < DEEPEST:
                    cells = [((*path, r, c), cell, depth + 1) for r, row in enumerate(_children(e, "tr")) for c, cell in enumerate(_children(row, "tc"))]
                    todo.extend(reversed(cells))
            else:
                todo.extend(reversed([((*path, i), c, depth) for i, c in enumerate(_children(e, "p tbl"))]))
        out, at = [], 0
        for path, text, runs in found:
            out.append((list(path), at, at + len(text), runs, text))
            at += len(text) + 1
        return None, out
    except Refused as e:
        return str(e), []
    except (zipfile.BadZipFile, zlib.error, struct.error, EOFError, RuntimeError, NotImplementedError, OSError):
        return "corrupt archive", []


def docx_blocks(files: DataFrame, by: list[str], content: str = "content") -> DataFrame:
    """Paragraphs of Word files: by, block_index, locator, container, path, char_start, char_end, runs, text,
    text_sha256, status, reason. A refused file, and one without paragraphs, is one row with index -1 and the locator of
    the whole part."""
    kind = "struct<reason string, blocks array<struct<path array<int>, char_start int, char_end int, runs int, text string>>>"
    read = F.udf(word_blocks, kind, useArrow=True)
    got = files.select(*by, read(content).alias("_g")).select(*by, F.col("_g.reason").alias("_why"), F.posexplode_outer("_g.blocks").alias("block_index", "_b"))
    steps = F.transform("_b.path", lambda n, i: F.concat(F.element_at(F.array(*map(F.lit, "brc")), i % 3 + 1), n.cast("string")))
    none = F.col("_b").isNull()
    text = F.when(none & F.col("_why").isNull(), F.lit("")).otherwise(F.col("_b.text"))
    zero = F.when(none & F.col("_why").isNull(), F.lit(0))
    return got.select(
        *by, F.coalesce("block_index", F.lit(-1)).alias("block_index"), F.concat(F.lit(MAIN + "#"), F.coalesce(F.array_join(steps, "/"), F.lit(""))).alias("locator"),
        F.when(none, "part").when(F.size("_b.path") == 1, "paragraph").otherwise("table-cell").alias("container"), F.col("_b.path").alias("path"), F.coalesce("_b.char_start", zero).alias("char_start"),
        F.coalesce("_b.char_end", zero).alias("char_end"), F.col("_b.runs").alias("runs"), text.alias("text"), F.sha2(text, 256).alias("text_sha256"),
        F.when(F.col("_why").isNotNull(), "extraction-failed").otherwise("extracted").alias("status"), F.coalesce("_why", F.when(none, "no paragraphs")).alias("reason"),
    )


_SHOWN = re.compile(rb"%[^\r\n]*|\(|[^\s()<>\[\]{}/%]+")
_PIECE = re.compile(rb"[^\\()]+|\\[0-7]{1,3}|\\\r\n|\\.|[()]|\\", re.S)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


def _literal(stream: bytes, at: int) -> tuple[bytes, int]:
    """The string whose bracket opens before ``at``, and where it ends."""
    out, depth = [], 1
    for m in _PIECE.finditer(stream, at):
        piece = m[0]
        depth += (piece == b"(") - (piece == b")")
        if not depth:
            return b"".join(out), m.end()
        if piece[:1] == b"\\":
            rest = piece[1:]
            piece = bytes([int(rest, 8) & 255]) if rest[:1].isdigit() and rest < b"8" else _ESCAPED.get(rest, rest)
        out.append(piece)
    return b"".join(out), len(stream)


def _shown(stream: bytes) -> str:
    """Literal strings of a content stream; a show operator other than the spaced one ends a line."""
    out, at = [], 0
    while m := _SHOWN.search(stream, at):
        at = m.end()
        if m[0] == b"(":
            s, at = _literal(stream, at)
            out.append(s.decode("latin-1"))
        elif m[0] in (b"Tj", b"'", b'"'):
            out.append("\n")
    return "".join(out)


def _inflated(data: bytes):
    """(dictionary, inflated bytes) of each Flate stream that can be read; one past the bound is refused."""
    at = 0
    while m := re.compile(rb"(?<!end)stream(?:\r\n|\n|\r)").search(data, at):
        at = m.end()
        head = data[max(data.rfind(b"obj", 0, m.start()), 0) : m.start()]
        if b"/FlateDecode" not in head:
            end = data.find(b"endstream", at)
            at = end if end >= 0 else at
            continue
        d = zlib.decompressobj()
        try:
            got = d.decompress(data[at:], MOST_PART)
        except zlib.error:
            continue
        if d.unconsumed_tail:
            raise Refused("size_limit:stream")
        if d.eof:
            at = len(data) - len(d.unused_data)
            yield head, got


_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")


def _objects(data: bytes, inflated: list[tuple[bytes, bytes]]) -> tuple[dict[int, bytes], list[bytes]]:
    """Objects by number, a later one in place of an earlier: those in the open, without their streams, and those packed in
    object streams. Also what stands after 'trailer' marks and in cross-reference streams' dictionaries, in order."""
    found: dict[int, bytes] = {}
    for m in _OBJECT.finditer(data):
        end = data.find(b"endobj", m.end())
        body = data[m.end() : end if end >= 0 else len(data)]
        found[int(m[1])] = re.split(rb"\bstream[\r\n]", body, maxsplit=1)[0]
    for head, got in inflated:
        first = re.search(rb"/First\s+(\d+)", head)
        if re.search(rb"/Type\s*/ObjStm\b", head) and first:
            numbers = [int(x) for x in got[: int(first[1])].split()]
            places = [*numbers[1::2], len(got) - int(first[1])]
            for number, a, b in zip(numbers[::2], places, places[1:], strict=False):
                found.setdefault(number, got[int(first[1]) + a : int(first[1]) + b])
    tails = [piece.split(b"startxref", 1)[0] for piece in data.split(b"trailer")[1:]]
    return found, tails + [d for d in found.values() if re.search(rb"/Type\s*/XRef\b", d)]


def page_count(data: bytes, inflated: list[tuple[bytes, bytes]]) -> int | None:
    """The count of the page tree that the file's catalog names: from the last trailer's root, to its pages, to their count."""
    objects, tails = _objects(data, inflated)

    def follow(where: bytes, name: bytes) -> bytes | None:
        m = re.search(rb"/" + name + rb"\s+(\d+)\s+\d+\s+R\b", where)
        return objects.get(int(m[1])) if m else None

    roots = [r for t in tails if (r := follow(t, b"Root")) is not None]
    catalog = roots[-1] if roots else next((d for d in reversed(list(objects.values())) if re.search(rb"/Type\s*/Catalog\b", d)), None)
    pages = follow(catalog, b"Pages") if catalog is not None else None
    count = re.search(rb"/Count\s+(\d+)", pages) if pages is not None else None
    return int(count[1]) if count else None


def pdf_text(raw: bytes | None) -> tuple[str | None, int | None, list[str]]:
    """(reason, pages by the page tree, texts): a text for each Flate stream that shows any, in the file's order."""
    try:
        if raw is None:
            raise Refused("no file")
        raw = bytes(raw)
        streams = list(_inflated(raw))
        shown = [_shown(got) for head, got in streams if not re.search(rb"/Type\s*/(?:ObjStm|XRef)\b", head)]
        texts = [t for t in shown if t.strip()]
        return None if texts else "no text stream that can be decoded", page_count(raw, streams), texts
    except Refused as e:
        return str(e), None, []


def pdf_pages(files: DataFrame, by: list[str], content: str = "content") -> DataFrame:
    """Pages of simple PDF files: by, page_number (the order of their text streams), n_pages by the page tree (null:
    unknown), text, text_sha256, status, reason. A file without readable text is one failed page."""
    read = F.udf(pdf_text, "struct<reason string, n_pages int, texts array<string>>", useArrow=True)
    got = files.select(*by, read(content).alias("_g")).select(*by, "_g.reason", "_g.n_pages", F.posexplode_outer("_g.texts").alias("_i", "text"))
    return got.select(
        *by, (F.coalesce("_i", F.lit(0)) + 1).alias("page_number"), "n_pages", F.coalesce("text", F.lit("")).alias("text"), F.sha2("text", 256).alias("text_sha256"),
        F.when(F.col("reason").isNotNull(), "extraction-failed").otherwise("extracted").alias("status"), "reason",
    )


def draft_kind(name: Column, content: Column) -> Column:
    """Struct of reader (docx, pdf, text) and refusal: by the name's extension, refused where the bytes say otherwise."""
    base = F.lower(F.element_at(F.split(name, "/"), -1))
    ext = F.when(F.contains(base, F.lit(".")), F.substring_index(base, ".", -1)).otherwise("")
    starts = lambda *marks: F.hex(F.substring(content, 1, 8)).rlike("^(?:" + "|".join(marks) + ")")
    archive, pdf, ole, rtf = starts("504B0304", "504B0506"), starts("255044462D"), starts(OLE_MARK), starts("7B5C727466")
    pdf_near = F.contains(F.substring(content, 1, 1024), F.lit(b"%PDF-"))
    refusal = (
        F.when(name.isNull() | content.isNull(), "no file").when(ext == "docx", F.when(~archive, "not a zip archive")).when(ext == "pdf", F.when(~pdf_near, "not a PDF"))
        .when(ext.isin("doc", "rtf", "odt", "pages"), "unsupported format").when(archive, "an archive under a text name").when(pdf, "a PDF under a text name").when(ole | rtf, "a word processor's file under a text name")
    )
    reader = F.when(ext.isin("docx", "pdf"), ext).otherwise("text")
    return F.struct(F.when(refusal.isNull(), reader).alias("reader"), refusal.alias("refusal"))
