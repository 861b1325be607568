"""Three-way routing: exact cache hit, similar behaviour, novel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe import params
from vigilframe.functions import records
from vigilframe.operators.similarity import top_matches


def live(cache: DataFrame, as_of: Column) -> DataFrame:
    """Unexpired cache rows, the latest one per key."""
    fresh = cache.where(F.col("expires_at") > as_of)
    cols = [c for c in cache.columns if c != "fingerprint"]
    return fresh.groupBy("fingerprint").agg(*[F.max_by(F.col(c), "cached_at").alias(c) for c in cols])


def cached(decisions: DataFrame, ttl_days: int = params.DECISION_TTL_DAYS) -> DataFrame:
    """Cache rows for final decisions (fingerprint, ..., cached_at)."""
    return decisions.withColumn("expires_at", F.col("cached_at") + F.make_dt_interval(F.lit(ttl_days)))


def exact_hits(events: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    hits = live(cache, as_of).select("fingerprint", F.struct("decision_id", "risk_score").alias("hit"))
    return events.join(hits, events["content_fingerprint"] == hits["fingerprint"], "left").drop("fingerprint")


def route(
    events: DataFrame,
    cache: DataFrame,
    vectors: DataFrame,
    as_of: Column,
    threshold: float = params.FUZZY_THRESHOLD,
    novel: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(evidence_id, path, similarity, decision_id, risk_score, reason) per event.

    ``events``: evidence_id BIGINT, content_fingerprint, criticality, embedding.
    ``vectors``: vector_id BIGINT, fingerprint, criticality, embedding.
    ``novel`` may add decisions for the remainder.
    """
    probed = exact_hits(events, cache, as_of)
    exact = probed.where("hit IS NOT NULL").select(
        "evidence_id", F.lit(1).alias("path"), F.lit(1.0).alias("similarity"),
        F.col("hit.decision_id").alias("decision_id"), F.col("hit.risk_score").alias("risk_score"),
        F.lit("exact").alias("reason"),
    )
    rest = probed.where("hit IS NULL").drop("hit")
    nearest = top_matches(
        rest, vectors, 1, query_id="evidence_id", query_vector="embedding", vector_id="vector_id", vector="embedding"
    )
    known = vectors.select("vector_id", "fingerprint", F.col("criticality").alias("_other"))
    decisions = live(cache, as_of).select("fingerprint", "decision_id", "risk_score")
    judged = (
        rest.select("evidence_id", "criticality")
        .join(nearest.withColumnRenamed("query_id", "evidence_id"), "evidence_id", "left")
        .join(known, "vector_id", "left")
        .join(decisions, "fingerprint", "left")
    )
    reason = (
        F.when(F.col("similarity").isNull(), "no_results")
        .when(F.col("similarity") < threshold, "below_threshold")
        .when(F.col("criticality") != F.col("_other"), "criticality_mismatch")
        .when(F.col("decision_id").isNull(), "no_cached_decision")
        .otherwise("fuzzy")
    )
    fuzzy = F.col("reason") == "fuzzy"
    rest_routed = judged.withColumn("reason", reason).select(
        "evidence_id",
        F.when(fuzzy, 2).otherwise(3).alias("path"),
        F.greatest(F.coalesce("similarity", F.lit(0.0)), F.lit(0.0)).alias("similarity"),
        F.when(fuzzy, F.col("decision_id")).alias("decision_id"),
        F.when(fuzzy, F.round(F.least(F.col("risk_score") * params.FUZZY_CONFIDENCE, F.lit(1.0)), 4)).alias("risk_score"),
        "reason",
    )
    routed = exact.unionByName(rest_routed)
    if novel is None:
        return routed
    return routed.where("path < 3").unionByName(novel(routed.where("path = 3")))


def routing_stats(routed: DataFrame, timing: str = "timing_ms") -> DataFrame:
    """One row: counts, shares and mean time per path, and the hit rate."""
    total = F.count(F.lit(1))
    cols = [total.alias("total")]
    for path in (1, 2, 3):
        hit = F.col("path") == path
        cols += [
            F.count_if(hit).alias(f"path_{path}_count"),
            F.round(F.count_if(hit) * 100 / total, 1).alias(f"path_{path}_pct"),
            F.coalesce(F.round(F.avg(F.when(hit, F.col(timing))), 3), F.lit(0.0)).alias(f"path_{path}_avg_ms"),
        ]
    cols += [
        F.round(F.avg(timing), 3).alias("avg_timing_ms"),
        F.round(F.count_if(F.col("path") < 3) * 100 / total, 1).alias("cache_hit_rate_pct"),
    ]
    return routed.agg(*cols)


def cache_summary(cache: DataFrame, as_of: Column, asked: DataFrame) -> DataFrame:
    """(fingerprint, exists) for each asked fingerprint: whether a live entry is held."""
    keys = live(cache, as_of).select("fingerprint", F.lit(True).alias("_held"))
    return asked.select("fingerprint").join(keys, "fingerprint", "left").select("fingerprint", F.col("_held").isNotNull().alias("exists"))


def cache_size(cache: DataFrame, as_of: Column) -> DataFrame:
    """One row: live entries. A cleared cache is an empty table."""
    return live(cache, as_of).agg(F.count("*").alias("entries"))
