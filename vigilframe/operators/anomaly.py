"""Running baselines, density model, signal fusion and embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.operators.running import exact_quantiles, running_moments, time_bucket

WARMUP = 10


def baseline_score(values: list[str], warmup: int = WARMUP) -> Column:
    """Score from the running moments: 1 - exp(-mean z / 3) after the warm-up."""
    z = [F.abs(F.col(v) - F.col(f"mean_{v}")) / F.sqrt(F.greatest(F.col(f"var_{v}"), F.lit(1e-8))) for v in values]
    mean_z = sum(z[1:], z[0]) / len(z)
    score = F.lit(1.0) - F.exp(-mean_z / F.lit(3.0))
    return F.when(F.col("n") < warmup, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def temporal_baseline(
    df: DataFrame,
    asset: str,
    micros: str,
    tie: str,
    values: list[str],
    warmup: int = WARMUP,
    bucket_seconds: int | None = None,
    seed: DataFrame | None = None,
) -> DataFrame:
    """Add n, mean, variance and ``temporal_score`` per row, row included.

    Rows are bucketed by number, or by ``bucket_seconds`` of time if given.
    """
    bucket = time_bucket(F.col(micros), bucket_seconds) if bucket_seconds else None
    moments = running_moments(df, [asset], [F.col(micros), F.col(tie)], bucket, values, seed)
    return moments.withColumn("temporal_score", baseline_score(values, warmup))


def baseline_state(df: DataFrame, asset: str, values: list[str], seed: DataFrame | None = None) -> DataFrame:
    """Per-asset state (_n, _mean_<v>, _m2_<v>), merged with an earlier state."""
    part = df.groupBy(asset).agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        *[F.avg(v).alias(f"_mean_{v}") for v in values],
        *[(F.var_pop(v) * F.count(v)).alias(f"_m2_{v}") for v in values],
    )
    if seed is None:
        return part
    both = part.unionByName(seed)
    total = F.sum("_n")
    merged = both.groupBy(asset).agg(
        total.alias("_n"),
        *[(F.sum(F.col("_n") * F.col(f"_mean_{v}")) / total).alias(f"_mean_{v}") for v in values],
        *[
            # exact merge of the two parts around their difference
            (
                F.sum(f"_m2_{v}")
                + F.coalesce(
                    F.product("_n") / total * F.pow(F.max(f"_mean_{v}") - F.min(f"_mean_{v}"), F.lit(2.0)), F.lit(0.0)
                ) * F.when(F.count(F.lit(1)) > 1, 1.0).otherwise(0.0)
            ).alias(f"_m2_{v}")
            for v in values
        ],
    )
    return merged


def refit_due(history: DataFrame, org: str, at: str, last_fit: DataFrame | None = None, min_rows: int = 100) -> DataFrame:
    """(org, rows, new_rows, due): does the organisation model need a refit.

    A model is fitted once ``min_rows`` samples exist and again after as many
    new ones. ``last_fit``: org, fitted_at.
    """
    if last_fit is None:
        joined = history.withColumn("fitted_at", F.lit(None).cast(history.schema[at].dataType))
    else:
        joined = history.join(last_fit.select(org, "fitted_at"), org, "left")
    fresh = F.col("fitted_at").isNull() | (F.col(at) > F.col("fitted_at"))
    counted = joined.groupBy(org).agg(F.count(F.lit(1)).alias("rows"), F.count_if(fresh).alias("new_rows"))
    return counted.withColumn("due", F.col("new_rows") >= min_rows)


def anomaly_stats(df: DataFrame, score: str = "anomaly_score", flagged: str = "is_anomalous") -> list[Column]:
    """Aggregates of the statistics report."""
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(flagged)).alias("anomalous"),
        F.round(F.count_if(F.col(flagged)) / F.count(F.lit(1)), 4).alias("anomaly_rate"),
        F.round(F.avg(score), 4).alias("avg_score"),
        F.round(F.max(score), 4).alias("max_score"),
        F.round(F.min(score), 4).alias("min_score"),
    ]


# -- density model -----------------------------------------------------------

def covariance(df: DataFrame, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector and sample covariance from one distributed aggregate."""
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    row = df.agg(
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)],
        *[F.covar_samp(values[i], values[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    mean = np.array([row[f"m{i}"] for i in range(len(values))], dtype=float)
    cov = np.empty((len(values), len(values)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    return mean, cov


def distance(values: list[str], mean: np.ndarray, inverse: np.ndarray) -> Column:
    """Mahalanobis distance as an expression over arrays; stays in the JVM."""
    gaps = F.array(*[F.col(v).cast("double") - F.lit(float(m)) for v, m in zip(values, mean)])
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in inverse])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, t: s + t)
    return F.sqrt(F.greatest(dot(F.transform(rows, lambda r: dot(r, gaps)), gaps), F.lit(0.0)))


def fit_density(df: DataFrame, values: list[str]) -> dict:
    """Mean, inverse covariance (+1e-6 I) and the 99th-percentile distance, at least 1."""
    mean, cov = covariance(df, values)
    cov = cov + np.eye(len(values)) * 1e-6
    try:
        inverse = np.linalg.inv(cov)
    except np.linalg.LinAlgError:
        inverse = np.diag(1.0 / np.diag(cov))
    (edge,) = exact_quantiles(df, distance(values, mean, inverse), [0.99])
    return {"values": values, "mean": mean, "inverse": inverse, "max_distance": max(edge, 1.0)}


def density_scores(df: DataFrame, model: dict) -> DataFrame:
    """Add ``distance``, ``density_score`` and ``epistemic``."""
    edge = F.lit(model["max_distance"])
    out = df.withColumn("distance", distance(model["values"], model["mean"], model["inverse"]))
    return out.withColumn("density_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("distance") / edge))).withColumn(
        "epistemic", F.lit(1.0) - F.exp(-F.col("distance") / edge)
    )


# -- fixed random projections (numpy inside Arrow batches) --------------------

SIGNAL_NAMES = ["dns", "auth", "process", "network"]


def with_fusion(df: DataFrame, flat: Column, width: int = 16, heads: int = 4, seed: int = 42) -> DataFrame:
    """Add ``fused``, ``fused_score`` and ``signal_weights`` from the signals laid end to end.

    Scaled dot-product attention with fixed seeded weights, run over Arrow
    batches; the score is half the length of the fused vector, at most 1.
    """
    staged = df.withColumn("_flat", flat)
    head = width // heads
    rng = np.random.RandomState(seed)
    wq, wk, wv, wo = (rng.randn(width, width).astype(np.float32) / np.sqrt(head) for _ in range(4))

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flats = batch.column("_flat")
            rows = batch.num_rows
            x = flats.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1, width)
            n = x.shape[1]
            q, k, v = ((x @ m).reshape(rows, n, heads, head).transpose(0, 2, 1, 3) for m in (wq, wk, wv))
            s = q @ k.transpose(0, 1, 3, 2) / np.sqrt(head)
            e = np.exp(s - s.max(axis=-1, keepdims=True))
            a = e / e.sum(axis=-1, keepdims=True)
            fused = ((a @ v).transpose(0, 2, 1, 3).reshape(rows, n, width) @ wo).mean(axis=1)
            w = a.mean(axis=(1, 2))
            w = np.round(w / w.sum(axis=1, keepdims=True), 4)
            score = np.clip(np.linalg.norm(fused, axis=1) / 2.0, 0.0, 1.0)
            keep = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "_flat"]
            names = [c for c in batch.schema.names if c != "_flat"]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(list(fused), pa.list_(pa.float64())), pa.array(score), pa.array(list(w), pa.list_(pa.float64()))],
                names=[*names, "fused", "fused_score", "signal_weights"],
            )

    schema = T.StructType(list(df.schema.fields))
    for name, kind in (("fused", T.ArrayType(T.DoubleType())), ("fused_score", T.DoubleType()), ("signal_weights", T.ArrayType(T.DoubleType()))):
        schema = schema.add(name, kind)
    return staged.mapInArrow(fuse, schema)


def with_embedding(df: DataFrame, features: Column, hidden: int = 64, outputs: int = 256, seed: int = 42) -> DataFrame:
    """Add ``behaviour``: a unit-length embedding through a fixed two-layer projection."""
    staged = df.withColumn("_features", features.cast("array<float>"))
    names = df.columns

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = None
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = batch.column("_features").flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
            if weights is None:
                rng = np.random.RandomState(seed)
                scale = np.sqrt(2.0 / (x.shape[1] + outputs))
                weights = [rng.randn(a, b).astype(np.float32) * np.float32(scale) for a, b in ((x.shape[1], hidden), (hidden, outputs))]
            e = np.maximum(x @ weights[0], 0) @ weights[1]
            norm = np.linalg.norm(e, axis=1, keepdims=True)
            e = np.divide(e, norm, out=np.zeros_like(e), where=norm > 0).astype(np.float32)
            offsets = pa.array(np.arange(0, (rows + 1) * outputs, outputs, dtype=np.int32))
            vectors = pa.ListArray.from_arrays(offsets, pa.array(e.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], vectors], names=[*names, "behaviour"])

    schema = T.StructType(list(df.schema.fields)).add("behaviour", T.ArrayType(T.FloatType()))
    return staged.mapInArrow(embed, schema)
