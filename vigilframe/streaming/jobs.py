"""Structured Streaming jobs.

State that must survive restarts lives in the engine's state store (``stateful``).
Outputs are written once per micro-batch id, so a repeated batch overwrites its own
output and never another one's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe import params
from vigilframe.operators import anomaly, enrich, ingest
from vigilframe.streaming import stateful


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Idempotent output of one micro-batch."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything available, then stop."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_stream(
    events: DataFrame, passed_path: str, held_path: str, checkpoint: str, normalise: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """Sanitise, trust-score and split; passed and quarantined rows go to two tables.

    ``events`` is a streaming frame with a ``raw`` map. ``normalise`` is applied to the rows that pass, as in a batch run.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        scored = ingest.ingest(batch).persist()
        try:
            passed, held = ingest.trust_split(scored)
            write_batch(normalise(passed) if normalise else passed, passed_path, batch_id)
            write_batch(held, held_path, batch_id)
        finally:
            scored.unpersist()

    run_available(events, each, checkpoint)


def baseline_stream(
    events: DataFrame, asset: str, micros: str, tie: str, values: list[str], out_path: str, checkpoint: str, lateness_seconds: int = 0
) -> None:
    """Per-asset running baseline over micro-batches: the rows of ``events`` with n, mean and variance, ``temporal_score`` and ``late``.

    Rows older than the newest instant of the batches before minus the allowed lateness are late: their place in the order has been
    scored already, so they are kept without moments and score.
    """
    added = ", ".join(["late boolean, n double", *(f"mean_{v} double, var_{v} double" for v in values)])
    states = stateful.clocked(events, micros, lateness_seconds).groupBy(asset).transformWithStateInPandas(
        stateful.Baseline(micros, tie, values), stateful.schema_with(events, added), "Append", "EventTime"
    )
    scored = states.withColumn("temporal_score", F.when(~F.col("late"), anomaly.baseline_score(values)))
    run_available(scored, lambda batch, batch_id: write_batch(batch, out_path, batch_id), checkpoint)


def rate_stream(calls: DataFrame, limits: DataFrame, micros: str, seconds: int, out_path: str, checkpoint: str, lateness_seconds: int = 0) -> None:
    """Exact sliding-rate alarms, and the late calls (``late``), which no count holds.

    ``calls``: agent_id, the instant and further columns. The agents' counts per instant are kept as far back as a call may look.
    """
    counted = stateful.clocked(calls, micros, lateness_seconds).groupBy("agent_id").transformWithStateInPandas(
        stateful.Rates(micros, seconds, lateness_seconds), stateful.schema_with(calls, "late boolean, calls bigint"), "Append", "EventTime"
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        limited = batch.join(limits, "agent_id", "left")
        write_batch(limited.where(F.col("late") | (F.col("calls") > F.coalesce("max_calls_per_minute", F.lit(600)))), out_path, batch_id)

    run_available(counted, each, checkpoint)


def first_seen_stream(events: DataFrame, key: str, at: str, life: str, out_path: str, checkpoint: str) -> None:
    """Only the first event per fingerprint within the cache life."""
    unique = events.withWatermark(at, life).dropDuplicatesWithinWatermark([key])
    unique.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(
        availableNow=True
    ).start().awaitTermination()


def matched_stream(
    events: DataFrame, values: Column, indicators: DataFrame, as_of: Column | Callable[[], Column], out_path: str, checkpoint: str
) -> None:
    """Indicator match of every micro-batch against the indicators that have not expired when it runs.

    ``as_of`` is a function that gives the instant of a micro-batch, or one instant for all.
    """
    from vigilframe.operators.federation import matched

    def each(batch: DataFrame, batch_id: int) -> None:
        now = as_of() if callable(as_of) and not isinstance(as_of, Column) else as_of
        write_batch(matched(batch, values, indicators, now), out_path, batch_id)

    run_available(events, each, checkpoint)


def reputation_stream(
    rows: DataFrame, micros: str, out_path: str, checkpoint: str, ttl_hours: int = params.REPUTATION_TTL_HOURS, lateness_seconds: int = 0
) -> None:
    """Hunt score of every sighting by the newest reputation of its (type, value) that has not expired at the sighting's own instant.

    ``rows``: type, value, the instant, ``reputation`` and further columns. ``reputation`` is a struct (malicious, suspicious, undetected,
    harmless, vulns, tags) in rows that bring one, null in sightings. Sightings come out with ``reputation`` (null: none known or expired),
    ``hunt_score`` and ``late``.
    """
    kind = rows.schema["reputation"].dataType
    said = rows.withColumn("reputation", F.to_json("reputation"))
    answered = stateful.clocked(said, micros, lateness_seconds).groupBy("type", "value").transformWithStateInPandas(
        stateful.Expiring(micros, "reputation", ttl_hours * 3600), stateful.schema_with(said, "late boolean"), "Append", "EventTime"
    )
    known = answered.withColumn("reputation", F.from_json("reputation", kind))
    scored = known.withColumn("hunt_score", enrich.hunt_score(F.col("type"), *[F.col("reputation")[c] for c in enrich.REPUTATION_FIELDS]))
    run_available(scored, lambda batch, batch_id: write_batch(batch, out_path, batch_id), checkpoint)


def counter_stream(events: DataFrame, keys: list[str], counters: dict[str, Column], out_path: str, checkpoint: str) -> None:
    """Incremental counters: the engine keeps the aggregate state, and each micro-batch writes the keys that changed.

    ``latest_counters`` reads the last value of each key.
    """
    totals = events.groupBy(*keys).agg(*[c.alias(n) for n, c in counters.items()])
    query = (
        totals.writeStream.outputMode("update").foreachBatch(lambda batch, batch_id: write_batch(batch, out_path, batch_id))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest_counters(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Each key with the values of the last micro-batch that changed it."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])


def windowed_rates(events: DataFrame, key: str, at: str, watermark: str, length: str, slide: str, out_path: str, checkpoint: str) -> None:
    """Coarse sliding rates with event-time windows and a watermark for late rows."""
    rates = events.withWatermark(at, watermark).groupBy(F.window(at, length, slide), key).agg(F.count(F.lit(1)).alias("calls"))
    flat = rates.select(F.col("window.start").alias("start"), key, "calls")
    flat.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(
        availableNow=True
    ).start().awaitTermination()
