"""Queries over tool calls, composed from the given tables: every order is a call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import commands as C
from ..operators.guards import edit_region
from ..session import table
from .registry import query


def _pick(items: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (F.col("o_orderkey") % len(items) + 1).cast("int"))


#: Calls (a shell command unless marked as a program) and whether they write.
_CALLS = [
    ("grep x file", True, False), ("echo a > f", True, True), ("ls; rm -r x", True, True), ("cat a 2>&1", True, False), ("sed -n -i s/a/b/ f", True, True), ("sed -n p f", True, False), ("make >/dev/null 2>&1", True, False),
    ("git restore f", True, True), ("git log", True, False), ("find . -name x | xargs rm", True, True), ("echo 'rm x'", True, False), ("python3 -c \"open('f', 'w')\"", True, True),
    ("python - <<'END'\nopen('f', mode='rb')\nEND\n", True, False), ("bash -c 'touch f'", True, True), ("open('f', 'a')", False, True), ("open('f').read()", False, False), ("p.write_text('x')", False, True),
    ("import os\nos.remove('f')", False, True), ("x.remove('f')", False, False), ("shutil.copy(a, b", False, True),
]


@query(f"SELECT o_orderkey, v AS writes FROM orders JOIN (VALUES {', '.join(f'({i}, {str(w).lower()})' for i, (*_, w) in enumerate(_CALLS))}) t(m, v) ON o_orderkey % {len(_CALLS)} = m")
def write_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that look as if they write."""
    shell = F.array_contains(F.array(*[F.lit(i) for i, (_, s, _) in enumerate(_CALLS) if s]), (F.col("o_orderkey") % len(_CALLS)).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.writes(_pick([c for c, *_ in _CALLS]), shell).alias("writes"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4
  WHEN 0 THEN concat_ws(chr(10) || chr(10), 'cat', 'd.md', 'He said ' || o_custkey || '.' || chr(10) || 'So.')
  WHEN 1 THEN concat_ws(chr(10) || chr(10), 'printf', 'one ' || o_custkey || chr(10) || 'two', 'd.md')
  WHEN 2 THEN concat_ws(chr(10) || chr(10), 'open(', 'd.md', ', ', 'w', ').write(', 'He said ' || o_custkey, ')')
  ELSE concat_ws(chr(10) || chr(10), 'bash -c', 'echo', 'a "b" ' || o_custkey, 'x') END AS written FROM orders
""")
def command_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What calls write, as paragraphs: here-documents, quoted words, strings of programs, commands within commands."""
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("cat > d.md <<-'END' # note\n\tHe said "), c, F.lit(".\n\tSo.\n\tEND\n"))).when(k == 1, F.concat(F.lit("printf 'one "), c, F.lit("\\ntwo' >> d.md")))
        .when(k == 2, F.concat(F.lit("open('d.md', 'w').write('He '\n 'said "), c, F.lit("')"))).otherwise(F.concat(F.lit("bash -c 'echo \"a \\\"b\\\" "), c, F.lit("\" > x'")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", C.written_text(text, k != 2).alias("written"))


_FILE = "head {k}\nold line\nsame\ntail\n"
#: Patches over that file ("{k}" is the order's key): what the file holds after, or why it is refused.
_PATCHES = [
    ("*** Update File: f{k}\n@@ head\n-old line\n+new line\n same", "head {k}\nnew line\nsame\ntail\n", None), ("*** Update File: f{k}\n@@ same\n+added", "head {k}\nold line\nsame\nadded\ntail\n", None),
    ("*** Update File: f{k}\n+at the end", "head {k}\nold line\nsame\ntail\nat the end\n", None), ("*** Update File: f{k}\n-not there\n+x", "head {k}\nold line\nsame\ntail\n", "lines not found"),
    ("*** Update File: f{k}\n@@ l\n+x", "head {k}\nold line\nsame\ntail\n", "hint stands in several places"), ("*** Delete File: f{k}", None, None),
    ("*** Update File: f{k}\n-old line\n*** Update File: f{k}\n@@\n same\n-tail\n+last", "head {k}\n\nsame\nlast\n", None), ("*** Add File: f{k}\n+one\n+two", "one\ntwo\n", None),
]


def _literal(x: str | None) -> str:
    return "NULL" if x is None else "replace(" + " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in x.split("\n")) + ", '{k}', CAST(o_orderkey AS VARCHAR))"


def _by_case(values: list[str | None]) -> str:
    return f"CASE o_orderkey % {len(values)} " + " ".join(f"WHEN {i} THEN {_literal(v)}" for i, v in enumerate(values)) + " END"


@query(f"SELECT o_orderkey AS call_id, 'f' || o_orderkey AS path, {_by_case([a for _, a, _ in _PATCHES])} AS after, {_by_case([r for *_, r in _PATCHES])} AS refused FROM orders")
def patched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files after patches: updates, additions, deletions, hunks that don't fit."""
    calls, files = _patch_tables(spark, sf_dir)
    return C.patched(calls, files).select("call_id", "path", "after", "refused")


def _patch_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    own = lambda c: F.replace(c, F.lit("{k}"), F.col("o_orderkey").cast("string"))
    patch = own(F.concat(F.lit("*** Begin Patch\n"), _pick([p for p, *_ in _PATCHES]), F.lit("\n*** End Patch\n")))
    return o.select(F.col("o_orderkey").alias("call_id"), patch.alias("patch")), o.select(own(F.lit("f{k}")).alias("path"), own(F.lit(_FILE)).alias("text"))


@query("""
WITH f AS (SELECT o_orderkey, o_orderkey % 8 AS m, length('head ' || o_orderkey || chr(10)) AS h FROM orders)
SELECT o_orderkey AS call_id, CAST(CASE m WHEN 0 THEN h WHEN 1 THEN h + 14 WHEN 2 THEN h + 19 END AS BIGINT) AS start, CAST(CASE m WHEN 0 THEN h + 3 WHEN 1 THEN h + 20 WHEN 2 THEN h + 30 END AS BIGINT) AS new_end FROM f WHERE m < 3
""")
def patched_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where patched files differ from what they held: what a quotation check has to read again."""
    done = C.patched(*_patch_tables(spark, sf_dir)).where("refused is null and call_id % 8 < 3").withColumn("_r", edit_region(F.col("before"), F.col("after")))
    return done.select("call_id", F.col("_r.start").alias("start"), F.col("_r.new_end").alias("new_end"))
