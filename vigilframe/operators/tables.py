"""Keyed tables: upsert, insert-ignore, latest row, cache and log tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upserted(changes: DataFrame, key: str, seq: str, mutable: Iterable[str]) -> DataFrame:
    """One row per key: mutable columns from the last change, others from the first.

    Both come from partial aggregates, so a key with many changes never
    gathers in one task.
    """
    mutable = set(mutable)
    return changes.groupBy(key).agg(
        *[
            (F.max_by if c in mutable else F.min_by)(F.struct(c), F.col(seq))[c].alias(c)
            for c in changes.columns
            if c not in (key, seq)
        ]
    )


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def merge_into(path: str, changes: DataFrame, key: str, seq: str, mutable: Iterable[str], buckets: int = 64) -> None:
    """Upsert ``changes`` into the table at ``path``; only the buckets of the changed keys are read and written again.

    The rule is that of ``upserted``, over all change sets so far, in whatever order they come: mutable columns from the row with the
    greatest ``seq`` of the key, others from the one with the least. Rows lie in ``buckets`` folders by a hash of the key; choose as many as keep a bucket
    at a few hundred megabytes, and the same number for every change set (another one raises). The touched bucket numbers are the
    only thing the driver sees. One writer at a time; a failed job leaves the table as it was before its commit. A null key is a key of its own; an
    empty change set changes nothing. Column names with a leading underscore are taken.
    """
    mutable, bucket = set(mutable), f"_bucket_of_{buckets}"
    rest = [c for c in changes.columns if c not in (key, seq)]
    rows = changes.select(key, *rest, F.col(seq).alias("_first"), F.col(seq).alias("_last"), F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(bucket))
    stored = _stored(changes.sparkSession, path)
    if stored is not None:
        if bucket not in stored.columns:
            raise ValueError(f"the table at {path} has another number of buckets than {buckets}")
        touched = [r[0] for r in rows.select(bucket).distinct().collect()]
        rows = stored.where(F.col(bucket).isin(touched)).select(*rows.columns).unionByName(rows)
    kept = [(F.max_by(F.struct(c), "_last") if c in mutable else F.min_by(F.struct(c), "_first"))[c].alias(c) for c in rest]
    merged = rows.groupBy(bucket, key).agg(*kept, F.min("_first").alias("_first"), F.max("_last").alias("_last")).hint("rebalance", bucket)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(path)


def merged_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that ``merge_into`` keeps."""
    stored = spark.read.parquet(path)
    return stored.select(*[c for c in stored.columns if c not in ("_first", "_last") and not c.startswith("_bucket_of_")])


DECISION_MUTABLE = ["action_taken", "risk_score", "human_reviewed", "reviewer_id", "status", "extra_json"]
HYPOTHESIS_MUTABLE = [
    "goal", "confidence", "uncertainty", "state", "mitre_chain", "mission_impact", "extra_json",
]


def latest(df: DataFrame, keys: list[str], seq: Column) -> DataFrame:
    """The newest row per key."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_row"))
    return last.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def insert_ignored(existing: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """New rows whose key is not in the table; the first one where a key repeats."""
    rest = [c for c in new.columns if c != key]
    first = new.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(seq)).alias("_row"))
    fresh = first.select(key, *[F.col("_row")[c].alias(c) for c in rest])
    return fresh.join(existing.select(key), key, "left_anti")


def without_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def unreviewed(decisions: DataFrame, corrections: DataFrame) -> DataFrame:
    """Decisions named by no correction, neither as original nor as corrected."""
    named = corrections.select(F.col("original_decision_id").alias("decision_id")).union(
        corrections.select("corrected_decision_id")
    )
    return decisions.join(named.where("decision_id IS NOT NULL").distinct(), "decision_id", "left_anti")


def reviewed(decisions: DataFrame, corrections: DataFrame) -> DataFrame:
    """Apply the newest correction of each decision."""
    newest = latest(
        corrections.select("decision_id", "reviewer_id", "status", "new_action", "seq"), ["decision_id"], F.col("seq")
    ).select(
        "decision_id", F.col("reviewer_id").alias("_r"), F.col("status").alias("_s"), F.col("new_action").alias("_a"),
        F.lit(True).alias("_hit"),
    )
    joined = decisions.join(newest, "decision_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    return (
        joined.withColumn("human_reviewed", hit | F.col("human_reviewed"))
        .withColumn("reviewer_id", F.when(hit, F.col("_r")).otherwise(F.col("reviewer_id")))
        .withColumn("status", F.when(hit, F.col("_s")).otherwise(F.col("status")))
        .withColumn("action_taken", F.coalesce("_a", "action_taken"))
        .drop("_r", "_s", "_a", "_hit")
    )


def runs_with_decisions(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Runs with their decision, and the effective flag."""
    d = decisions.select("decision_id", "action_taken", "status", "human_reviewed")
    out = runs.join(d, "decision_id", "left")
    action = F.upper(F.coalesce("action_taken", F.lit("")))
    acted = F.col("decision_id").isNotNull() & ~action.isin("MONITOR", "NONE", "")
    return out.withColumn("effective_flag", F.col("flagged") | acted)


def newest(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The top rows of a report; planned as a distributed top-k."""
    return df.orderBy(*order).limit(limit)


def newest_per_key(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The top rows of every key; the limit is applied per key before the shuffle."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= limit).drop("_rank")


def with_extra(df: DataFrame, extra: str, schema: str) -> DataFrame:
    """Merge extra JSON into the row; a value given there wins."""
    parsed = df.withColumn("_extra", F.from_json(extra, schema))
    for field in parsed.schema["_extra"].dataType.fields:
        old = F.col(field.name) if field.name in df.columns else F.lit(None)
        parsed = parsed.withColumn(field.name, F.coalesce(F.col("_extra")[field.name], old))
    return parsed.drop("_extra")


def flat_properties(df: DataFrame, props: str) -> DataFrame:
    """Property struct -> columns: primitives stay, lists become lists of texts, the rest JSON text."""
    plain = (T.StringType, T.NumericType, T.BooleanType)
    cols = []
    for field in df.schema[props].dataType.fields:
        value = F.col(props)[field.name]
        if isinstance(field.dataType, T.ArrayType):
            value = F.transform(value, lambda v: v.cast("string"))
        elif isinstance(field.dataType, (T.StructType, T.MapType)):
            value = F.to_json(value)
        elif not isinstance(field.dataType, plain):
            value = value.cast("string")
        cols.append(value.alias(field.name))
    return df.select(*[c for c in df.columns if c != props], *cols)


def ingest_rows(df: DataFrame) -> DataFrame:
    """Ingest-event rows ready to append; the trace is kept as its number of steps."""
    return df.select(
        "event_id", "source", F.coalesce("trust_score", F.lit(0.0)).alias("trust_score"), F.coalesce("quarantined", F.lit(False)).alias("quarantined"),
        F.coalesce("flagged", F.lit(False)).alias("flagged"), F.coalesce("anomaly_score", F.lit(0.0)).alias("anomaly_score"),
        F.greatest(F.size(F.coalesce("trace", F.array().cast("array<string>"))), F.lit(0)).cast("bigint").alias("steps"),
    )


def security_log_rows(df: DataFrame, limit: int = 1000) -> DataFrame:
    """Security-log rows with the reason cut to the column width."""
    return df.withColumn("reason", F.substring("reason", 1, limit))


def matches_search(columns: list[Column], word: str) -> Column:
    """Case-insensitive search over several texts."""
    return F.lower(F.concat_ws(" ", *columns)).contains(word.lower())


def runs_from_log(log: DataFrame) -> DataFrame:
    """Runs read off the audit log, for a store without a run table.

    ``log``: audit_id, source, asset_id, risk_score, action_taken, decision_id, stored_at.
    """
    idle = F.col("action_taken").isNull() | F.col("action_taken").isin("MONITOR", "none")
    flagged = (F.coalesce("risk_score", F.lit(0.0)) > 0.6) | ~idle
    return log.select(
        F.col("audit_id").alias("run_id"), F.coalesce("source", F.lit("audit_log")).alias("source"), "asset_id", F.lit(False).alias("quarantined"),
        flagged.alias("flagged"), F.col("risk_score").alias("anomaly_score"), "decision_id", F.col("stored_at").alias("created_at"),
    )
