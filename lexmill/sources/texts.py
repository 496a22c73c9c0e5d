"""Text sources: files with hashes, pages, visible text of web pages, append logs, JSON sidecars, Markdown tables."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import digests

#: Folders that a case walk skips, beside the store folders that the caller names.
SKIPPED = (".git", ".hg", ".svn", ".venv", "venv", "node_modules", "__pycache__")
#: Files of up to so many bytes are one row of Spark's binary source. Of a larger one a task hashes so many at most.
WHOLE, TURN = 64 << 20, 512 << 20


def case_files(spark: SparkSession, root: str, nested: DataFrame | None = None, stores: tuple[str, ...] = (), whole: int = WHOLE, turn: int = TURN) -> DataFrame:
    """Files under root: rel_path, bytes, mtime, sha256. Skipped folders and, given their paths (column root), nested
    cases are left out. Bytes are hashed where they are read and don't leave the scan. Files of over ``whole`` bytes are
    hashed at once, by tasks in turn."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^.*?" + "\\Q" + root.rstrip("/") + "\\E/", "")
    files = df.select("path", rel.alias("rel_path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), "content")
    files = files.where(~F.arrays_overlap(F.split("rel_path", "/"), F.array(*[F.lit(x) for x in (*SKIPPED, *stores)])))
    if nested is not None:
        n = nested.select(F.col("root").alias("nested_root"))
        files = files.join(F.broadcast(n), F.col("rel_path").startswith(F.concat("nested_root", F.lit("/"))), "left_anti")  # case folders: few
    own, large = F.sha2("content", 256).alias("sha256"), F.col("bytes") > whole
    found = hashed(spark, [tuple(r) for r in files.where(large).select("path", "bytes").collect()], turn)
    if not found:
        return files.select("rel_path", "bytes", "mtime", own)
    sums = spark.createDataFrame(list(found.items()), "path string, sha256 string")
    rest = files.where(large).drop("content").join(F.broadcast(sums), "path", "left")  # a row for each large file
    return files.where(~large).select("rel_path", "bytes", "mtime", own).unionByName(rest.drop("path"))


def hashed(spark: SparkSession, files: list[tuple[str, int]], turn: int = TURN) -> dict[str, str]:
    """SHA-256 of each of files (path, bytes). All files' hashes go on by ``turn`` bytes in each round, a task a file; only
    their states, a hundred bytes each, pass through the driver. Empty if Python can't open them all: a mount table of
    Spark's own, say. Spark's binary source must read such files whole, up to its 2 GB."""
    left, done = [(p, n, 0, b"") for p, n in files], {}
    while left:
        got = spark.sparkContext.parallelize(left, len(left)).map(lambda f: _went_on(*f, turn)).collect()
        if None in got:
            return {}
        done |= {p: h for p, n, at, h in got if at == n}
        left = [f for f in got if f[2] < f[1]]
    return done


def _went_on(path: str, size: int, at: int, state: bytes, turn: int) -> tuple[str, int, int, bytes | str] | None:
    """A file with the place that its hash has come to, and its state there or, at the end, the digest."""
    try:
        f = opened(path)
    except (OSError, ValueError, NotImplementedError):
        if at:
            raise
        return None
    if digests.resumable():
        end = min(size, at + turn)
    else:  # from the start and to the end
        at, end, state = 0, size, b""
    with f:
        f.seek(at)
        h = digests.sha256(state)
        while at < end:
            if not (b := f.read(min(end - at, 4 << 20))):
                raise EOFError(f"{path} ended at {at} of {size} bytes")
            h.update(b)
            at += len(b)
        return path, size, at, h.hexdigest() if at == size else h.state()


def opened(path: str) -> BinaryIO:
    """A stream of a path as Spark writes it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    from pyarrow.fs import FileSystem

    server, _, inner = rest.removeprefix("//").partition("/")
    fs, top = FileSystem.from_uri(f"{scheme}://{server}/")
    return fs.open_input_file(f"{top.rstrip('/')}/{inner}")


BREAK = r"(?i)\f|<!--\s*PAGEBREAK\s*-->"


def pages_of(c: Column) -> Column:
    """Array of pages: cut at form feeds and page-break comments; a blank last page is dropped."""
    return _whole(F.split(c, BREAK, -1))


def _whole(p: Column) -> Column:
    return F.when(~F.element_at(p, -1).rlike(r"\S"), F.slice(p, 1, F.size(p) - 1)).otherwise(p)


def split_pages(df: DataFrame, text: str) -> DataFrame:
    """A row for each page: page_number from 1, page, and n_pages (null where the text has no break: unknown). The text is
    cut once; more than one part means a break."""
    keep = [c for c in df.columns if c != text]
    out = df.select(*keep, F.transform(F.array(F.split(F.col(text), BREAK, -1)), lambda p: F.struct(_whole(p).alias("pages"), (F.size(p) > 1).alias("cut")))[0].alias("_p"))
    out = out.select(*keep, F.when(F.col("_p.cut"), F.size("_p.pages")).alias("n_pages"), F.posexplode("_p.pages").alias("_i", "page"))
    return out.withColumn("page_number", F.col("_i") + 1).drop("_i")


class _Visible(HTMLParser):
    HIDDEN = {"script", "style", "noscript", "template"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.HIDDEN

    def handle_endtag(self, tag):
        if tag in self.HIDDEN and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth and (t := " ".join(data.split())):
            self.parts.append(t)


def visible_text(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Visible()
    p.feed(html)
    p.close()
    return "\n".join(p.parts)


def with_visible_text(df: DataFrame, html: str, out: str = "visible") -> DataFrame:
    """Adds the text that a reader would see, one line for each text node. Parsing needs state, so it runs in
    Arrow batches."""

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(visible_text)

    return df.withColumn(out, read(F.col(html)))


def append_log(lines: DataFrame, schema: StructType | str, key: list[str], order: str = "line_no") -> DataFrame:
    """Newest whole record of each key in a JSON-lines log (value, line_no); torn lines are skipped."""
    got = lines.select(order, F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).where(F.col("r").isNotNull() & F.col(f"r.{key[0]}").isNotNull())
    return got.groupBy(*[F.col(f"r.{k}").alias(f"_{k}") for k in key]).agg(F.max_by("r", order).alias("r"), F.max(order).alias(order)).select("r.*", order)


def markdown_tables(df: DataFrame, text: str, by: str) -> DataFrame:
    """Cells of Markdown tables: by, line_no, table_no, heads and cells (arrays). Header and rule lines are left out."""
    lines = df.select(by, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    w = Window.partitionBy(by).orderBy("line_no")
    rule = F.col("line").rlike(r"^\s*\|?\s*:?-{2,}")
    row = F.trim("line").startswith("|")
    inner = F.regexp_replace(F.trim("line"), r"^\||\|$", "")
    cells = F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))
    out = lines.withColumn("rule", rule).withColumn("header", F.lead(rule, 1, False).over(w) & row).withColumn("cells", F.when(row, cells))
    # A table ends where its lines do: a row counts while every line since its header was one.
    out = out.withColumn("table_no", F.sum(F.col("header").cast("int")).over(w)).withColumn("heads", F.last(F.when(F.col("header"), F.col("cells")), True).over(w))
    broken = F.max(F.when(~row & ~F.col("rule"), F.col("line_no"))).over(w)
    begun = F.max(F.when(F.col("header"), F.col("line_no"))).over(w)
    out = out.withColumn("_in", F.coalesce(broken, F.lit(-1)) < begun)
    return out.where(row & ~F.col("rule") & ~F.col("header") & F.col("_in")).select(by, "line_no", "table_no", "heads", "cells")


def by_heading(tables: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The cells of ``markdown_tables`` under names: for each name the first column whose heading fits its pattern, null
    where no heading does or the row is too short."""
    at = lambda p: F.array_position(F.transform("heads", lambda h: F.lower(h).rlike(p)), F.lit(True))
    named = [F.when(at(p) > 0, F.try_element_at("cells", at(p).cast("int"))).alias(n) for n, p in columns.items()]
    return tables.select(*[c for c in tables.columns if c not in ("heads", "cells")], *named)
