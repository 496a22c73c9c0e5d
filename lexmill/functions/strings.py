"""Column functions over text: normalisation, keys, references, paths, URLs. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The five labels that a fact can carry.
FACT_LABELS = ("DOCUMENTED", "ALLEGED", "DISPUTED", "UNKNOWN", "PRIVILEGED")


def word_key(c: Column) -> Column:
    """Lower case, only letters and digits."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def normalize(c: Column) -> Column:
    """Exotic spaces to a space, zero-width marks dropped, hyphens and apostrophes plain, ligatures spelt out,
    runs of white space to one space, ends trimmed."""
    c = F.translate(c, "\u200b\u200c\u200d\u2060\ufeff\u00ad", "")
    c = F.translate(c, "\u2010\u2011\u2012\u2013\u2014\u2212\u2018\u2019\u02bc\u201c\u201d", "------'''\"\"")
    for one, two in (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl")):
        c = F.replace(c, F.lit(one), F.lit(two))
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def ascii_digits(c: Column) -> Column:
    """Arabic-Indic, extended Arabic-Indic, Devanagari and full-width decimal digits to ASCII."""
    starts = (0x660, 0x6F0, 0x966, 0xFF10)
    return F.translate(c, "".join(chr(s + d) for s in starts for d in range(10)), "0123456789" * len(starts))


def reporter_key(c: Column) -> Column:
    """A reporter's name without spaces, dots and apostrophes, in lower case; the appendix has one alias."""
    k = F.lower(F.regexp_replace(c, r"[\s.'’]", ""))
    return F.when(k == "fedappx", "fappx").otherwise(k)


def authority_key(c: Column) -> Column:
    """Spaces, section signs and commas dropped, and dots that don't stand between digits."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"[\s§,]", "")), r"(?<!\d)\.|\.(?!\d)", "")


def ref_parts(c: Column, last: bool = False) -> Column:
    """reference@locator at the first @ (facts) or the last one (amendments): struct(ref, locator or null)."""
    at = F.length(c) - F.locate("@", F.reverse(c)) + 1 if last else F.locate("@", c)
    has = F.contains(c, F.lit("@"))
    return F.struct(
        F.when(has, F.substring(c, F.lit(1), at - 1)).otherwise(c).alias("ref"),
        F.when(has, F.substring(c, at + 1, F.length(c))).alias("locator"),
    )


def canonical_url(c: Column) -> Column:
    """http(s) addresses: scheme and host in lower case, no fragment, no trailing slashes, the query kept. Else null."""
    u = F.trim(c)
    part = lambda i: F.regexp_extract(u, r"(?i)^(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?", i)
    path = F.regexp_replace(part(3), "/+$", "")
    url = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.when(path == "", "/").otherwise(path), F.when(part(4) == "?", "").otherwise(part(4)))
    return F.when(part(2) != "", url)


def stable_id(c: Column, prefix: str = "or_", length: int = 12) -> Column:
    """A deterministic id: the prefix and the first hex digits of SHA-256."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, length))


def safe_path(c: Column) -> Column:
    """Relative, not empty, and never up: what a document's path must be."""
    return (c != "") & ~c.startswith("/") & ~F.array_contains(F.split(c, "/"), "..") & ~F.contains(c, F.lit("\\"))


def fact_label(c: Column) -> Column:
    """A label with dashes and underscores as spaces, in upper case; null if it isn't one of the five."""
    k = F.upper(F.trim(F.regexp_replace(c, "[-_]", " ")))
    return F.when(k.isin(*FACT_LABELS), k)


def table_cell(c: Column) -> Column:
    """Text for a Markdown table cell."""
    return F.replace(F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))


def page_ranges(c: Column) -> Column:
    """'45-7, 52' as an array of (lo, hi): a short end takes the leading digits of its start."""
    parts = F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d+(\s*[-–]\s*\d+)?$"))

    def one(p: Column) -> Column:
        lo = F.regexp_extract(p, r"^(\d+)", 1)
        hi = F.regexp_extract(p, r"[-–]\s*(\d+)$", 1)
        full = F.when(hi == "", lo).when(F.length(hi) < F.length(lo), F.concat(F.substring(lo, F.lit(1), F.length(lo) - F.length(hi)), hi)).otherwise(hi)
        return F.struct(lo.cast("long").alias("lo"), full.cast("long").alias("hi"))

    return F.transform(parts, one)


def ranges_covered(asked: Column, checked: Column) -> Column:
    """Every range asked for lies inside some checked one."""
    return F.forall(asked, lambda r: F.exists(checked, lambda h: (h["lo"] <= r["lo"]) & (r["hi"] <= h["hi"])))


def line_of(text: Column, offset: Column) -> Column:
    """Line number, from 1, of a zero-based offset."""
    head = F.substring(text, F.lit(1), offset)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def plain_terminal(c: Column) -> Column:
    """Markdown marks removed for a plain terminal."""
    c = F.regexp_replace(c, r"(?m)^#{1,6}\s+", "")
    c = F.regexp_replace(c, r"\*\*([^*]+)\*\*", "$1")
    c = F.regexp_replace(c, r"`([^`]+)`", "$1")
    return F.regexp_replace(c, r"\[([^\]]+)\]\([^)]*\)", "$1")
