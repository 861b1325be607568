"""Call-log policy checks against agent profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe import params
from vigilframe.operators.running import trailing_counts


def policy_violations(calls: DataFrame, profiles: DataFrame) -> DataFrame:
    """(call_id, agent_id, violation, actual, severity), one row per violation.

    ``calls``: call_id, agent_id, output_type, action, path, schema_ok.
    ``profiles``: agent_id, forbidden_output_types, forbidden_actions,
    forbidden_paths (arrays), expected_output_schema.
    """
    joined = calls.join(profiles, "agent_id")
    low = lambda c: F.lower(F.regexp_replace(c, r"\\", "/"))
    path = low(F.coalesce("path", F.lit("")))
    kind = F.col("output_type")
    checks = F.array(
        F.when(
            F.array_contains("forbidden_output_types", kind),
            F.struct(
                F.lit("output_type_mismatch").alias("violation"), kind.alias("actual"),
                F.when(kind.isin("Decision", "Hypothesis"), "CRITICAL").otherwise("HIGH").alias("severity"),
            ),
        ),
        F.when(
            (F.col("expected_output_schema") != "dict") & ~F.col("schema_ok"),
            F.struct(F.lit("schema_validation_failure").alias("violation"), F.col("expected_output_schema").alias("actual"), F.lit("WARN").alias("severity")),
        ),
        F.when(
            F.exists("forbidden_actions", lambda a: F.lower(a) == F.lower("action")),
            F.struct(F.lit("forbidden_action").alias("violation"), F.col("action").alias("actual"), F.lit("CRITICAL").alias("severity")),
        ),
        F.when(
            F.exists("forbidden_paths", lambda p: path.contains(low(p))),
            F.struct(F.lit("forbidden_path_access").alias("violation"), F.col("path").alias("actual"), F.lit("CRITICAL").alias("severity")),
        ),
    )
    found = F.filter(checks, lambda c: c.isNotNull())
    return joined.select("call_id", "agent_id", F.explode(found).alias("v")).select("call_id", "agent_id", "v.*")


def rate_violations(calls: DataFrame, limits: DataFrame, micros: str = "micros", seconds: int = 60) -> DataFrame:
    """Calls at which the agent's trailing count exceeds its limit.

    ``limits``: agent_id, max_calls_per_minute.
    """
    counted = trailing_counts(calls, ["agent_id"], micros, seconds)
    limited = counted.join(limits, "agent_id", "left")
    return limited.where(F.col("calls") > F.coalesce("max_calls_per_minute", F.lit(600)))


def severity_rank(severity: Column) -> Column:
    expr = None
    for name, rank in params.SEVERITY_RANK.items():
        expr = F.when(severity == name, F.lit(rank)) if expr is None else expr.when(severity == name, F.lit(rank))
    return expr.otherwise(F.lit(0))


def suspended(violations: DataFrame, releases: DataFrame | None = None, protected: str = "A11") -> DataFrame:
    """(agent_id, since): agents with a critical violation that no later release lifts.

    The watchdog itself is never suspended. ``violations``: agent_id, severity, seq.
    """
    bad = (
        violations.where((F.col("severity") == "CRITICAL") & (F.col("agent_id") != protected))
        .groupBy("agent_id").agg(F.max("seq").alias("since"))
    )
    if releases is None:
        return bad
    lifted = releases.groupBy("agent_id").agg(F.max("seq").alias("_released"))
    return bad.join(lifted, "agent_id", "left").where(F.coalesce(F.col("_released") <= F.col("since"), F.lit(True))).drop("_released")
