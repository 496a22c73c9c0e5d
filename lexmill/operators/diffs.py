"""Added lines of unified and combined diffs. Native: windows over a diff's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt


def unquoted(path: Column) -> Column:
    """A diff's path without its quotes; octal escapes are bytes of UTF-8."""
    inner = F.regexp_extract(path, '^"(.*)"$', 1)
    parts = F.regexp_extract_all(inner, F.lit(r"(\\[0-7]{3}|\\.|[^\\]+)"), F.lit(1))
    plain = lambda p: F.hex(F.encode(p, "UTF-8"))
    simple = lambda p: F.when(p == "\\t", "09").when(p == "\\n", "0A").otherwise(plain(F.substring(p, 2, 1)))
    byte = lambda p: F.when(p.rlike(r"^\\[0-7]{3}$"), F.lpad(F.conv(F.substring(p, 2, 3), 8, 16), 2, "0")).when(p.startswith("\\"), simple(p)).otherwise(plain(p))
    return F.when(path.startswith('"'), F.decode(F.unhex(F.array_join(F.transform(parts, byte), "")), "UTF-8")).otherwise(path)


def added_lines(lines: DataFrame, by: list[str], order: str = "line_no", line: str = "line") -> DataFrame:
    """Lines that a diff adds: by, path, new_line, text. A hunk's head tells how many lines it has on the new side, so an
    added line that looks like a file's head stays a line. A combined diff has a mark for each parent; a line is added
    if one of its marks says so."""
    # Dealt by number of tasks: left to itself the shuffle, small as alike lines are written, ends in a few large tasks.
    lines = dealt(lines, *by)
    w = Window.partitionBy(*by).orderBy(order)
    x = F.col(line)
    head = r"^(@@+) .*\+([0-9]+)(?:,([0-9]+))? (@@+)"
    is_head = x.rlike(head)
    d = lines.select(*by, order, x.alias("_x"), F.count_if(is_head | x.startswith("diff ")).over(w).alias("_hunk"), F.when(is_head, x).alias("_head"))
    h = Window.partitionBy(*by, "_hunk")
    at = h.orderBy(order)
    size = F.regexp_extract("_head", head, 3)
    d = d.withColumn("_marks", F.max(F.length(F.regexp_extract("_head", head, 1)) - 1).over(h)).withColumn("_from", F.max(F.regexp_extract("_head", head, 2).cast("int")).over(h))
    d = d.withColumn("_size", F.max(F.when(size == "", 1).otherwise(size.try_cast("int"))).over(h))
    marks = F.substring(F.col("_x"), F.lit(1), F.coalesce("_marks", F.lit(1)))
    new = F.col("_head").isNull() & F.col("_marks").isNotNull() & marks.rlike(r"^[ +]+$")
    d = d.withColumn("_m", marks).withColumn("_n", F.count_if(new).over(at)).withColumn("_in", new & (F.col("_n") <= F.col("_size")))
    file = F.when(~F.col("_in") & F.col("_x").startswith("+++ "), F.regexp_replace(unquoted(F.regexp_replace(F.substring("_x", 5, 1 << 20), r"\t.*$", "")), "^b/", ""))
    d = d.withColumn("path", F.last(file, ignorenulls=True).over(w))
    return d.where(F.col("_in") & F.contains("_m", F.lit("+"))).select(*by, "path", (F.col("_from") + F.col("_n") - 1).alias("new_line"), F.expr("substring(_x, _marks + 1)").alias("text"))
