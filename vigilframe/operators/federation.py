"""Indicator sharing: publish, expire, match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe import params
from vigilframe.functions import records, scoring, text


def expired(created: Column, as_of: Column, ttl_days: int = params.INDICATOR_TTL_DAYS) -> Column:
    """Older than the time to live, or unreadable."""
    at = F.regexp_replace(created, "Z$", "").try_cast("timestamp")
    age = records.micros(as_of) - records.micros(at)
    return F.coalesce(age > F.lit(ttl_days * 86_400_000_000), F.lit(True))


def unexpired(indicators: DataFrame, as_of: Column, ttl_days: int = params.INDICATOR_TTL_DAYS) -> DataFrame:
    return indicators.where(~expired(F.col("created"), as_of, ttl_days))


def shareable(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    return df.where(F.col(confidence) > params.SHARE_THRESHOLD)


def without_personal_fields(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in params.PII_FIELDS if c in df.columns])


def published(events: DataFrame, text_column: str, created: Column, org: str) -> DataFrame:
    """One indicator row per shareable value of a confident event.

    ``events``: event_id, confidence and the text. Events without any value
    yield nothing; personal fields never leave.
    """
    found = text.shareable_entities(F.col(text_column))
    picked = shareable(events).select("event_id", F.round("confidence", 4).alias("confidence"), found.alias("found"))
    tag = lambda values, kind: F.transform(values, lambda v: F.struct(kind(v).alias("ioc_type"), v.alias("ioc_value")))
    rows = F.concat(
        tag(F.col("found.ips"), lambda _: F.lit("ip")),
        tag(F.col("found.hashes"), records_hash_kind),
        tag(F.col("found.domains"), lambda _: F.lit("domain")),
    )
    out = picked.select("event_id", "confidence", F.explode(rows).alias("r")).select("event_id", "confidence", "r.*")
    kind = F.col("ioc_type")
    return out.select(
        F.concat(F.lit("indicator--"), F.substring(F.sha2(F.concat_ws("|", F.lit(org), F.col("event_id").cast("string"), kind, F.col("ioc_value")), 256), 1, 32)).alias("id"),
        "event_id", "ioc_type", "ioc_value", "confidence",
        text.stix_pattern(kind, F.col("ioc_value")).alias("pattern"),
        F.when(kind.startswith("hash"), F.array(F.lit("malicious-activity"), F.lit("malware")))
        .otherwise(F.array(F.lit("malicious-activity"), F.lit("c2"))).alias("labels"),
        F.lit(org).alias("org_id"),
        created.alias("created"),
    )


def records_hash_kind(value: Column) -> Column:
    return text.hash_kind(value)


def matched(events: DataFrame, values: Column, indicators: DataFrame, as_of: Column) -> DataFrame:
    """(event_id, matches, boost): unexpired indicators whose value the event holds.

    Indicators are counted per lower-cased value first, so a value listed very
    often is one row in the join.
    """
    stored = F.lower(text.stix_pattern_value(F.col("pattern")))
    counts = unexpired(indicators, as_of).where(stored.isNotNull()).groupBy(stored.alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    exploded = events.select("event_id", F.explode(F.array_distinct(F.transform(values, lambda v: F.lower(v)))).alias("_value"))
    hits = exploded.join(counts, "_value").groupBy("event_id").agg(F.sum("_n").cast("bigint").alias("matches"))
    return hits.withColumn("boost", scoring.federation_boost(F.col("matches")))
