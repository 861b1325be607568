"""Ingest: source trust, trust split, sanitising, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe import params
from vigilframe.functions import records, text


def trust_score(label: Column, table=params.TRUST_TABLE) -> Column:
    """Exact hit, else the first table row where one string holds the other, else 0.

    The table is a short fixed list, so the lookup is one expression and needs
    no join. The normalised label is bound once, which keeps the expression
    small when the trust filter is pushed down. Very short labels match almost
    any row; that is kept as it is.
    """
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("score")) for k, v in table])
    exact = F.create_map(*[F.lit(x) for kv in table for x in kv])

    def score(key: Column) -> Column:
        near = F.filter(rows, lambda r: F.contains(key, r["key"]) | F.contains(r["key"], key))
        found = F.coalesce(F.try_element_at(exact, key), F.try_element_at(near, F.lit(1))["score"])
        return F.when(key == "", F.lit(params.TRUST_UNKNOWN)).otherwise(F.coalesce(found, F.lit(params.TRUST_UNKNOWN)))

    return records.bound(records.normalized_label(label), score)


def with_trust(df: DataFrame, label: str = "source") -> DataFrame:
    return df.withColumn("trust_score", records.clipped_trust(trust_score(F.col(label))))


def trust_split(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passed, quarantined). Both are filters on the same narrow plan."""
    zero = F.col("trust_score") == 0
    held = scored.where(zero).withColumn("reason", F.lit("Unknown source with trust_score 0.00"))
    return scored.where(~zero), held


def ingest(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Label, trust, sanitised fields and protocol tag for raw MAP events.

    One narrow stage: no shuffle, no Python.
    """
    clean = df.withColumn("source", records.source_label(F.col(raw)))
    clean = with_trust(clean).withColumn("sanitized", text.sanitize_map(F.col(raw)))
    return clean.withColumn(
        "protocol", text.first_signature(text.keys_and_values(F.col("sanitized")), params.OT_SIGNATURES_V1)
    )


def validated(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good, bad); bad rows carry the names of the failed checks."""
    failed = F.filter(
        F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]),
        lambda f: f.isNotNull(),
    )
    marked = df.withColumn("failed_checks", failed)
    return marked.where(F.size("failed_checks") == 0).drop("failed_checks"), marked.where(F.size("failed_checks") > 0)


def evidence_checks(dim: int = 256) -> dict[str, Column]:
    return {
        "content_fingerprint": records.is_hex_digest(F.col("content_fingerprint")),
        "behavior_embedding": F.size("behavior_embedding") == dim,
        "confidence": records.is_unit(F.col("confidence")),
        "uncertainty": records.is_unit(F.col("uncertainty")),
    }


HYPOTHESIS_STATES = ["ACTIVE_INVESTIGATION", "CONFIRMED", "REJECTED", "CONTAINED"]
