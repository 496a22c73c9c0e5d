"""Grants and budgets: which requests to a provider a case's grants allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Payload types by how much they tell; a default covers the first only.
SENSITIVITY = {"citation": 0, "query": 1, "text": 2}


def authorize(requests: DataFrame, grants: DataFrame, used: DataFrame, now: Column) -> DataFrame:
    """requests (request_id, provider, endpoint, payload, caller) with allowed, grant_id and refusals.

    grants: grant_id, provider, kind (human, agent, default, declined), endpoints, payloads, callers, issuer,
    daily_budget, expires. used: provider, used (today's requests). Agents' grants are proposals and allow nothing;
    a person's allow the issuer and the callers named ('*': all); a default allows citations unless a person has
    declined the provider; a grant past its day, or whose budget is used up, allows nothing.
    """
    declined = grants.where("kind = 'declined'").select("provider", F.lit(True).alias("declined")).distinct()
    g = grants.where("kind <> 'declined'").join(used.groupBy("provider").agg(F.sum("used").alias("used")), "provider", "left")
    r = requests.join(declined, "provider", "left").withColumn("declined", F.coalesce("declined", F.lit(False)))
    j = r.join(g.withColumnRenamed("provider", "_p"), (F.col("provider") == F.col("_p")) & F.array_contains("endpoints", F.col("endpoint")), "left")
    has = F.col("grant_id").isNotNull()
    human = (F.col("caller") == F.col("issuer")) | F.array_contains("callers", F.col("caller")) | F.array_contains("callers", "*")
    why = (
        F.when(~has, None)
        .when(~F.array_contains("payloads", F.col("payload")), "payload outside the grant")
        .when((F.col("kind") == "default") & (F.col("payload") != "citation"), "a default covers bare citations only")
        .when((F.col("kind") == "default") & F.col("declined"), "turned off by a person")
        .when(F.col("kind") == "agent", "an agent's grant is a proposal")
        .when((F.col("kind") == "human") & ~F.coalesce(human, F.lit(False)), "the caller is neither the issuer nor named")
        .when(F.col("expires") < now, "the grant has expired")
        .when(F.coalesce("used", F.lit(0)) >= F.col("daily_budget"), "the daily budget is used up")
    )
    ok = has & why.isNull()
    out = j.groupBy("request_id").agg(F.min(F.when(ok, F.col("grant_id"))).alias("grant_id"), F.sort_array(F.collect_set(why)).alias("refusals"), F.bool_or("declined").alias("declined"))
    off = F.col("declined") & ~F.array_contains("refusals", "turned off by a person")
    refusals = F.when(off, F.array_prepend("refusals", F.lit("turned off by a person"))).otherwise(F.col("refusals"))
    return out.select("request_id", F.col("grant_id").isNotNull().alias("allowed"), "grant_id", F.when(F.col("grant_id").isNull(), F.when(F.size(refusals) > 0, refusals).otherwise(F.array(F.lit("no matching grant")))).alias("refusals"))
