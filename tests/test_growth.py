"""Steps whose work must not grow faster than their rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from vigilframe.operators import attribution, audit, models, running, similarity
from vigilframe.sources import graphs
from vigilframe.streaming import stateful


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_forest_walks_every_row_once(spark):
    rng = np.random.RandomState(3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.randn(400, 2))] + [(400, float("nan"), 0.5)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double")
    model = models.fit_forest(df, "id", ["a", "b"], trees=20, size=64)
    score = lambda d: {r["id"]: r["isolation_score"] for r in models.forest_scores(d, model).collect()}
    assert score(model["scored"]) == score(df) and len(score(df)) == 401
    assert "Python" not in plan_of(models.forest_scores(model["scored"], model))


class Store:
    """State of one key, with the number of its writes."""

    def __init__(self):
        self.held, self.writes = {}, 0

    def exists(self):
        return bool(self.held)

    def iterator(self):
        return iter([((at,), (n,)) for at, n in self.held.items()])

    def updateValue(self, key, value):
        self.held[key[0]], self.writes = value[0], self.writes + 1

    def removeKey(self, key):
        del self.held[key[0]]

    def listTimers(self):
        return []

    def registerTimer(self, at):
        pass

    def getCurrentWatermarkInMs(self):
        return 0


def test_rates_write_only_instants_in_reach(spark):
    store, job = Store(), stateful.Rates("micros", 60, 40)
    job.handle = job.instants = store
    at = np.arange(1, 1001) * 1_000_000
    (out,) = job.handleInputRows(("A",), iter([pd.DataFrame({"micros": at})]), store)
    assert out["calls"].tolist() == [min(i, 61) for i in range(1, 1001)]
    assert store.writes == 101 and min(store.held) == 900_000_000


def test_zip_never_broadcasts_rows(spark, folder):
    spark.range(50).write.parquet(folder + "/a")
    spark.range(50).selectExpr("id * 2 AS two").write.parquet(folder + "/b")
    both = graphs.zipped_by_position(spark.read.parquet(folder + "/a"), spark.read.parquet(folder + "/b"))
    assert "SortMergeJoin [_row" in plan_of(both) and both.where("two = id * 2").count() == 50


def test_trailing_counts_are_one_running_sum(spark):
    rng = np.random.RandomState(5)
    data = [(i, f"k{rng.randint(2)}", int(rng.randint(-90, 300)) * 500_000) for i in range(400)]
    counted = running.trailing_counts(spark.createDataFrame(data, "i int, k string, micros bigint"), ["k"], "micros", 30)
    assert "RangeFrame" not in plan_of(counted)
    want = {i: sum(a == k and at - 30_000_000 <= t <= at for _, a, t in data) for i, k, at in data}
    assert {r["i"]: r["calls"] for r in counted.collect()} == want


def test_similarities_held_at_a_time_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(similarity, "CELLS", 500)
    rng, most = np.random.RandomState(6), []
    q, v = rng.randn(70, 5), rng.randn(100, 5)
    partition = np.partition
    held = lambda a, k: most.append(a.base.size if a.base is not None else a.size) or partition(a, k)
    monkeypatch.setattr(similarity.np, "partition", held)
    got = similarity._best(np.arange(70), q, np.arange(100), v, 3, False).to_pydict()
    want = np.argsort(-(q @ v.T), axis=1)[:, :3]
    assert np.array_equal(np.array(got["vector_id"]).reshape(70, 3), want) and max(most) <= 500


def test_vectors_out_of_reach_are_not_shuffled(spark, monkeypatch):
    rng = np.random.RandomState(11)
    x, y = np.zeros((80, 30)), np.abs(rng.normal(size=(3000, 30)))
    x[:, :6] = 1 + 0.2 * rng.uniform(size=(80, 6))
    y[:100, 6:] = 0  # the others have most of their length where no query has anything
    y[40:60] = y[7]
    y[60] = 0
    q = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "query_id bigint, q array<double>")
    v = spark.createDataFrame([(int(i), y[i].tolist()) for i in rng.permutation(3000)], "vector_id bigint, v array<double>")
    visited, seen = similarity._visited, []
    monkeypatch.setattr(similarity, "_visited", lambda vectors, *rest: seen.append(vectors.count()) or visited(vectors, *rest))
    got = similarity.top_matches(q, v, 5, query_vector="q", vector="v", broadcast_bytes=0, block_bytes=30 * 64).collect()
    length = np.linalg.norm(y, axis=1, keepdims=True)
    sims = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ np.divide(y, length, out=np.zeros_like(y), where=length > 0).T, 12)
    assert {(r["query_id"], r["rank"]): r["vector_id"] for r in got} == {(i, n + 1): j for i in range(80) for n, j in enumerate(np.lexsort((np.arange(3000), -sims[i]))[:5])}
    assert len(seen) == 1 and seen[0] <= 300


def test_best_of_copies_and_of_known_kth():
    rng = np.random.RandomState(12)
    q, v = rng.randn(50, 4), rng.randn(6000, 4)[rng.randint(0, 300, 6000)]
    sims = np.round(q @ v.T, 12)
    want = [np.lexsort((np.arange(6000), -row))[:3].tolist() for row in sims]
    some = similarity._least_copies(v, 3)
    assert len(some) <= 900 and all(set(w) <= set(some) for w in want)
    for kth in (None, np.sort(sims, axis=1)[:, -3], np.where(np.arange(50) % 2, -np.inf, np.sort(sims, axis=1)[:, -40])):
        for ids, m in ((np.arange(6000), v), (some, v[some])):
            got = similarity._best(np.arange(50), q, ids, m, 3, False, kth).to_pydict()
            assert np.array(got["vector_id"]).reshape(50, 3).tolist() == want
    other = similarity._best(np.arange(50), q, np.arange(6000), v, 3, True).to_pydict()
    rows = [[j for j in np.lexsort((np.arange(6000), -sims[i])) if j != i][:3] for i in range(50)]
    assert np.array(other["vector_id"]).reshape(50, 3).tolist() == rows


def test_texts_are_embedded_in_batches(spark):
    texts = ["é" * 900 + "😀a", "x" * 384, "y" * 385, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", attribution.text_embedding(F.col("t")).alias("e"))
    assert "ArrowEvalPython" in plan_of(df)
    got = {r["i"]: r["e"] for r in df.collect()}
    for i, text in enumerate(texts[:4]):
        slots = np.zeros(384)
        for j, c in enumerate(text):
            slots[j % 384] += ord(c)
        assert np.allclose(got[i], slots / max(np.linalg.norm(slots), 1e-300), rtol=0, atol=1e-15)
    assert got[4] is None


def test_chains_take_no_call_per_leaf(spark):
    rows = spark.range(300).selectExpr("id % 40 AS k", "id AS micros", "id")
    log = audit.chained(rows, "k", [F.col("micros")], F.floor(F.col("micros") / 50), ["id"], leaf=3)
    assert "FlatMapGroups" not in plan_of(log) and "MapInArrow" in plan_of(log)
    assert log.count() == 300 and audit.chain_report(log.localCheckpoint(), "k").where("not valid").count() == 0


def test_proofs_of_a_hot_key_stay_with_their_parts(spark):
    rows = spark.range(60).selectExpr("'hot' AS k", "0L AS segment", "id + 1 AS seq", "cast(id AS string) AS payload")
    proofs = audit.inclusion_proofs(rows, "k")
    assert "Join [k" not in plan_of(proofs) and sorted(r["seq"] for r in proofs.collect()) == list(range(1, 61))


def test_baseline_keeps_late_rows_apart(spark):
    class Moments(Store):
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def getCurrentWatermarkInMs(self):
            return 10

    job = stateful.Baseline("at", "i", ["x"])
    store = job.moments = Moments()
    frames = [pd.DataFrame({"i": [1, 0], "at": [12, 12], "x": [4.0, 2.0]}), pd.DataFrame({"i": [2, 3], "at": [3, 11], "x": [9.0, 6.0]})]
    (out,) = job.handleInputRows(("A",), iter(frames), store)
    assert out["i"].tolist() == [3, 0, 1, 2] and out["late"].tolist() == [False, False, False, True]
    assert out["n"].tolist()[:3] == [1, 2, 3] and np.allclose(out["mean_x"][:3], [6, 4, 4]) and np.isnan(out["mean_x"][3])
    assert store.value[0] == 3.0 and np.isclose(store.value[2], 8.0)


def test_sequences_are_scored_once(spark):
    rng = np.random.RandomState(9)
    seqs = spark.createDataFrame([(i, rng.randn(12).tolist()) for i in range(60)], "seq bigint, sequence array<double>")
    model = models.fit_sequences(seqs, 4, 3, hidden=6, latent=3)
    score = lambda d: {r["seq"]: r["sequence_score"] for r in models.sequence_scores(d, model).collect()}
    assert score(model["scored"]) == score(seqs) and len(score(seqs)) == 60
    assert "Python" not in plan_of(models.sequence_scores(model["scored"], model))
