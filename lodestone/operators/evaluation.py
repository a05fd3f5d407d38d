"""Retrieval quality: hits, recall, reciprocal rank, abstention, threshold sweep and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V


def applies_to(channels, channel: str | None):
    """Whether an evaluation query applies to an index of a channel."""
    none = F.size(F.coalesce(channels, F.array().cast("array<string>"))) <= 0
    return none if channel is None else none | F.coalesce(F.array_contains(channels, channel), F.lit(False))


def first_hits(results: DataFrame, gold: DataFrame, k: int = V.EVAL_K) -> DataFrame:
    """(query_id, kind, hit_rank): rank of the first relevant result; NULL without one."""
    wanted = gold.select("query_id", "kind", F.transform(F.coalesce("relevant", F.array().cast("array<string>")), F.lower).alias("relevant"))
    hit = results.filter(F.col("rank") <= k).join(wanted, "query_id").filter(
        F.exists("relevant", lambda s: F.lower(F.coalesce(F.col("path"), F.lit(""))).contains(s))
    )
    return wanted.select("query_id", "kind").join(hit.groupBy("query_id").agg(F.min("rank").alias("hit_rank")), "query_id", "left")


def quality(hits: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: positives, recall, mean reciprocal rank, wrong abstentions, share of negatives that abstain, gates."""
    j = hits.join(verdicts.select("query_id", "insufficient_evidence"), "query_id")
    positive = F.col("kind") != "negative"
    m = j.agg(
        F.count_if(positive).alias("positives"), F.count_if(~positive).alias("negatives"),
        F.coalesce(F.avg(F.when(positive, F.col("hit_rank").isNotNull().cast("double"))), F.lit(0.0)).alias("recall"),
        F.coalesce(F.avg(F.when(positive, F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0)))), F.lit(0.0)).alias("mrr"),
        F.count_if(positive & F.col("insufficient_evidence")).alias("wrong_abstentions"),
        F.coalesce(F.avg(F.when(~positive, F.col("insufficient_evidence").cast("double"))), F.lit(1.0)).alias("negative_abstain"),
    )
    return m.select(
        "positives", "negatives", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), "wrong_abstentions", F.round("negative_abstain", 6).alias("negative_abstain"),
        ((F.col("recall") >= V.MIN_RECALL) & (F.col("negative_abstain") >= V.MIN_NEGATIVE_ABSTAIN) & (F.col("wrong_abstentions") == 0)).alias("passed"),
    )


def floor_sweep(verdicts: DataFrame, gold: DataFrame) -> DataFrame:
    """Positives and negatives that would abstain at every threshold, by the rounded confidence alone."""
    j = gold.select("query_id", "kind").join(verdicts.select("query_id", "confidence"), "query_id")
    floors = F.explode(F.array(*(F.lit(x) for x in V.SWEEP))).alias("floor")
    low = F.col("confidence") < F.col("floor")
    return j.select("*", floors).groupBy("floor").agg(
        F.count_if(low & (F.col("kind") != "negative")).alias("positives_abstaining"), F.count_if(low & (F.col("kind") == "negative")).alias("negatives_abstaining")
    )
