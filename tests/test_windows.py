import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.operators import anomaly, running


def rows(n=600, seed=1):
    """One hot asset with most rows."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        asset = "hot" if rng.random() < 0.7 else f"a{rng.randrange(4)}"
        out.append((asset, i, rng.randrange(0, 5_000_000) * 1000, 1e6 + rng.gauss(0, 5)))
    return out


def twin_baseline(data, warmup=10):
    """Online update per row, current row included."""
    stats, out = {}, {}
    for asset, i, m, v in sorted(data, key=lambda r: (r[2], r[1])):
        n, mean, m2 = stats.get(asset, (0, 0.0, 0.0))
        n += 1
        delta = v - mean
        mean += delta / n
        m2 += delta * (v - mean)
        stats[asset] = (n, mean, m2)
        out[i] = 0.0 if n < warmup else 1 - math.exp(-abs(v - mean) / math.sqrt(max(m2 / (n - 1), 1e-8)) / 3)
    return out


@pytest.mark.parametrize("bucket, partitions", [(1, 3), (600, 8), (10_000_000, 1)])
def test_baseline_equals_online_update(spark, bucket, partitions):
    data = rows()
    df = spark.createDataFrame(data, "asset string, i bigint, micros bigint, v double").repartition(partitions)
    got = anomaly.temporal_baseline(df, "asset", "micros", "i", ["v"], bucket_seconds=bucket)
    got = {r["i"]: r["temporal_score"] for r in got.collect()}
    want = twin_baseline(data)
    assert len(got) == len(data)
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_baseline_continues_from_state(spark):
    data = sorted(rows(), key=lambda r: (r[2], r[1]))
    schema = "asset string, i bigint, micros bigint, v double"
    first, second = spark.createDataFrame(data[:350], schema), spark.createDataFrame(data[350:], schema)
    seed = anomaly.baseline_state(first, "asset", ["v"])
    got = {r["i"]: r["temporal_score"] for r in anomaly.temporal_baseline(second, "asset", "micros", "i", ["v"], seed=seed).collect()}
    want = twin_baseline(data)
    assert max(abs(got[i] - want[i]) for i in got) < 1e-6
    merged = {r["asset"]: r for r in anomaly.baseline_state(second, "asset", ["v"], seed).collect()}
    whole = {r["asset"]: r for r in anomaly.baseline_state(first.unionByName(second), "asset", ["v"]).collect()}
    for a, r in whole.items():
        assert merged[a]["_n"] == r["_n"] and merged[a]["_m2_v"] == pytest.approx(r["_m2_v"], rel=1e-6)


def test_hot_key_is_split(spark):
    """The row-level window is partitioned by key and bucket, never by key alone."""
    df = spark.createDataFrame(rows(), "asset string, i bigint, micros bigint, v double")
    plan = anomaly.temporal_baseline(df, "asset", "micros", "i", ["v"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "avg(v" not in line and "v#" in line and "_before_s" in line]
    assert all("_bucket" in w for w in windows)


def test_trailing_counts_match_a_deque(spark):
    rng = random.Random(3)
    data = [("A" if rng.random() < 0.8 else "B", i, rng.randrange(0, 400) * 1_000_000) for i in range(500)]
    df = spark.createDataFrame(data, "agent_id string, i bigint, micros bigint")
    got = {r["i"]: r["calls"] for r in running.trailing_counts(df, ["agent_id"], "micros", 60).collect()}
    for agent, i, m in data:
        assert got[i] == sum(a == agent and m - 60_000_000 <= t <= m for a, _, t in data)


def test_row_positions(spark):
    data = rows(300, 5)
    df = spark.createDataFrame(data, "asset string, i bigint, micros bigint, v double")
    got = running.row_positions(df, ["asset"], [F.col("micros"), F.col("i")], running.time_bucket(F.col("micros"), 700)).collect()
    by = {}
    for a, i, m, _ in sorted(data, key=lambda r: (r[2], r[1])):
        by.setdefault(a, []).append(i)
    assert all(by[r["asset"]][r["seq"] - 1] == r["i"] for r in got)


@pytest.mark.parametrize("chunk", [10, 64, 10_000])
def test_sequences(spark, chunk):
    df = spark.range(230).select((F.col("id") * 1000).alias("micros"), "id")
    got = running.sliding_sequences(df, [F.col("micros")], F.floor(F.col("id") / 50), F.col("id"), 10, chunk=chunk).collect()
    assert sorted((r["seq"], r["sequence"]) for r in got) == [(i + 10, list(range(i, i + 10))) for i in range(221)]


@pytest.mark.parametrize("cells, direct", [(4, 10), (64, 100), (2048, 100_000)])
def test_quantiles_equal_numpy(spark, cells, direct):
    rng = np.random.RandomState(0)
    vals = np.concatenate([rng.normal(size=700), np.full(300, 0.25), rng.exponential(1e6, 50)])
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "v double")
    probs = [0.0, 0.05, 0.5, 0.95, 0.99, 1.0]
    got = running.exact_quantiles(df, F.col("v"), probs, cells=cells, direct=direct)
    assert got == pytest.approx(list(np.quantile(vals, probs)))


def test_density_equals_numpy(spark):
    rng = np.random.RandomState(1)
    x = rng.normal(size=(400, 3)) @ np.array([[1, 0.3, 0], [0, 2, 0.1], [0, 0, 0.5]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i bigint, a double, b double, c double")
    model = anomaly.fit_density(df, ["a", "b", "c"])
    inv = np.linalg.inv(np.cov(x, rowvar=False) + np.eye(3) * 1e-6)
    dist = np.array([np.sqrt((r - x.mean(0)) @ inv @ (r - x.mean(0))) for r in x])
    assert model["max_distance"] == pytest.approx(max(np.percentile(dist, 99), 1.0))
    got = {r["i"]: r for r in anomaly.density_scores(df, model).collect()}
    assert max(abs(got[i]["distance"] - dist[i]) for i in range(400)) < 1e-9
    assert all(0 <= r["density_score"] <= 1 for r in got.values())


def test_fusion_equals_a_per_row_twin(spark):
    rng = np.random.RandomState(7)
    flat = rng.rand(20, 64)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(flat)], "i bigint, flat array<double>")
    got = {r["i"]: r for r in anomaly.with_fusion(df, F.col("flat")).collect()}
    rng = np.random.RandomState(42)
    wq, wk, wv, wo = (rng.randn(16, 16).astype(np.float32) * (1 / np.sqrt(4)) for _ in range(4))
    for i, r in enumerate(flat):
        x = r.reshape(4, 16)
        heads = []
        received = np.zeros(4)
        for h in range(4):
            s = slice(4 * h, 4 * h + 4)
            e = np.exp((x @ wq)[:, s] @ (x @ wk)[:, s].T / 2.0)
            a = e / e.sum(1, keepdims=True)
            received += a.mean(0) / 4
            heads.append(a @ (x @ wv)[:, s])
        fused = (np.hstack(heads) @ wo).mean(0)
        assert got[i]["fused_score"] == pytest.approx(min(1.0, np.linalg.norm(fused) / 2), abs=1e-6)
        assert np.allclose(got[i]["signal_weights"], np.round(received / received.sum(), 4), atol=1e-4)


def test_behaviour_embedding_is_unit_and_repeatable(spark):
    df = spark.createDataFrame([(i, [float(i + j) for j in range(20)]) for i in range(5)] + [(5, [0.0] * 20)], "i int, f array<double>")
    e = [r["behaviour"] for r in anomaly.with_embedding(df, F.col("f")).orderBy("i").collect()]
    rng = np.random.RandomState(42)
    w1, w2 = (rng.randn(a, b).astype(np.float32) * np.sqrt(2.0 / 276) for a, b in ((20, 64), (64, 256)))
    want = np.maximum(np.arange(20) @ w1, 0) @ w2
    assert np.allclose(e[0], want / np.linalg.norm(want), atol=1e-4)
    norms = [np.linalg.norm(v) for v in e]
    assert all(len(v) == 256 for v in e) and np.allclose(norms[:5], 1, atol=1e-5) and norms[5] == 0
