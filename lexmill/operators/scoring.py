"""Scoring extracted spans against labelled ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN = ["doc", "start", "end"]


def match(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """Gold spans with the prediction that takes each: equal spans, each prediction taken once, first come first."""
    g = gold.withColumn("_n", F.row_number().over(Window.partitionBy(*SPAN).orderBy("item_id")))
    p = preds.select(*SPAN, "pred_id", F.row_number().over(Window.partitionBy(*SPAN).orderBy("pred_id")).alias("_n"))
    return g.join(p, [*SPAN, "_n"], "left").drop("_n").withColumn("matched", F.col("pred_id").isNotNull())


def false_positives(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """Predictions that no gold span takes."""
    used = match(gold, preds).where("matched").select("pred_id")
    return preds.join(used, "pred_id", "left_anti")


def hygiene(misses: DataFrame, preds: DataFrame, most: int = 2) -> DataFrame:
    """Missed gold spans for which some prediction starts alike and is longer by at most ``most`` characters."""
    p = preds.select("doc", "start", F.col("text").alias("p_text")).distinct()
    near = F.col("p_text").startswith(F.col("text")) & (F.length("p_text") <= F.length("text") + most)
    return misses.join(p, ["doc", "start"]).where(near).groupBy(*misses.columns).agg(F.min("p_text").alias("predicted"))


#: Characters by which a gold text is looked up in a prediction.
HEAD = 8


def pollution(gold: DataFrame, preds: DataFrame, head: int = HEAD) -> DataFrame:
    """Predictions that hold a gold text of their document but not its span: the first such gold of each. A prediction asks
    with its pieces of ``head`` characters, whatever the gold texts' lengths, and a hit is read on to the gold's end; gold
    texts shorter than that are looked up by their own few lengths. Of each gold text the first items of two spans are
    enough to answer."""
    first = gold.groupBy(*SPAN, "text").agg(F.min("item_id").alias("item_id"))
    first = first.withColumn("_r", F.row_number().over(Window.partitionBy("doc", "text").orderBy("item_id"))).where("_r <= 2")
    n = F.least(F.length("text"), F.lit(head))
    g = first.select("doc", n.alias("n"), F.substring(F.col("text"), F.lit(1), n).alias("piece"), F.col("text").alias("g_text"), F.col("start").alias("g_start"), F.col("end").alias("g_end"), "item_id")
    sized = preds.join(g.select("doc", "n").distinct(), "doc").where(F.col("n") <= F.length("text"))  # at most ``head`` lengths
    places = F.sequence(F.lit(1), F.length("text") - F.col("n") + 1)
    asked = sized.select("pred_id", *SPAN, "text", "n", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("text"), i, F.col("n"))))).alias("piece"))
    other = (F.col("start") != F.col("g_start")) | (F.col("end") != F.col("g_end"))
    hit = asked.join(g, ["doc", "n", "piece"]).where(other & F.contains("text", F.col("g_text")))
    return hit.groupBy("pred_id").agg(F.min("item_id").alias("item_id"))


def norm_mismatch(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """Matched pairs whose normalised text isn't the gold text."""
    return match(gold, preds).where("matched").join(preds.select("pred_id", "normalized"), "pred_id").where(F.col("normalized") != F.col("text"))


def recall(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """By set: gold, matched, recall (four places)."""
    m = match(gold, preds)
    return m.groupBy("set").agg(F.count("*").alias("gold"), F.count_if("matched").alias("found"), F.round(F.count_if("matched") / F.count("*"), 4).alias("recall"))


def collapse(preds: DataFrame) -> DataFrame:
    """Distinct spans and how many repeats each had."""
    return preds.groupBy(*SPAN).agg((F.count("*") - 1).alias("repeats"))


def gold_offsets(gold: DataFrame, docs: DataFrame) -> DataFrame:
    """Gold texts with the first place they stand in their document; missing is a row's own state, not an error. An empty
    gold text stands nowhere."""
    out = gold.join(docs.select("doc", F.col("text").alias("_t")), "doc", "left")
    at = F.when(F.col("text") != "", F.expr("instr(_t, text)"))
    return out.withColumn("start", F.when(at > 0, at - 1)).withColumn("end", F.col("start") + F.length("text")).withColumn("missing", F.coalesce(at, F.lit(0)) == 0).drop("_t")
