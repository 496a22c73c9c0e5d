"""Streams: daily request budgets and replayed requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_use(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Requests (provider, ts, event) by provider and day; a day closes when the watermark has passed it. Batch and
    stream alike."""
    seen = log.where("event is null or event <> 'note'")
    if seen.isStreaming:
        seen = seen.withWatermark("ts", late)
    out = seen.groupBy("provider", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("used"))
    return out.select("provider", F.to_date("w.start").alias("day"), "used")


def without_replays(log: DataFrame, key: str = "request_id", within: str = "1 hour") -> DataFrame:
    """Each request once, with a bounded memory: a replay later than the watermark allows counts anew."""
    if not log.isStreaming:
        return log.dropDuplicates([key])
    return log.withWatermark("ts", within).dropDuplicatesWithinWatermark([key])
