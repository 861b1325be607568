import hashlib

import pytest
from pyspark.sql import functions as F

from vigilframe.operators import audit, evaluate, models, report
import numpy as np


def chain(spark, n=25, segment=1000, parts=3):
    df = spark.range(n).select(F.lit("t").alias("tenant"), (F.col("id") * 7 % n).alias("at"), F.col("id").alias("v")).repartition(parts)
    return audit.chained(df, "tenant", [F.col("at")], F.floor(F.col("at") / segment), ["at", "v"])


def test_short_chain_is_linear(spark):
    rows = chain(spark).orderBy("seq").collect()
    prev = None
    for i, r in enumerate(rows):
        assert r["seq"] == i + 1 and r["prev_hash"] == prev
        prev = hashlib.sha256(((prev or "") + r["payload"]).encode()).hexdigest()
        assert r["entry_hash"] == prev
    assert audit.chain_report(chain(spark), "tenant").first()["valid"]


@pytest.mark.parametrize("segment", [1000, 6])
def test_every_kind_of_tampering_is_found(spark, segment):
    log = chain(spark, segment=segment).persist()
    assert audit.chain_report(log, "tenant").first().asDict() == {"tenant": "t", "entries": 25, "first_bad_seq": None, "valid": True}
    changed = log.withColumn("payload", F.when(F.col("seq") == 9, F.lit("{}")).otherwise(F.col("payload")))
    assert audit.chain_report(changed, "tenant").first()["first_bad_seq"] == 9
    removed = log.where("seq <> 9")
    assert audit.chain_report(removed, "tenant").first()["first_bad_seq"] == 10
    rehashed = changed.withColumn("entry_hash", F.when(F.col("seq") == 9, audit.link_hash(F.col("prev_hash"), F.col("payload"))).otherwise(F.col("entry_hash")))
    assert audit.chain_report(rehashed, "tenant").first()["first_bad_seq"] == 10
    log.unpersist()


def test_sealed_segments_notice_a_rewritten_segment(spark):
    """Rewriting a whole segment consistently still breaks the seal of the next one."""
    log = chain(spark, segment=5).persist()
    rows = [r.asDict() for r in log.orderBy("seq").collect()]
    prev = rows[4]["entry_hash"]
    prev = rows[5]["prev_hash"]
    for r in rows[5:10]:
        r["payload"] = r["payload"].replace("v", "w")
        r["prev_hash"] = prev
        prev = hashlib.sha256((prev + r["payload"]).encode()).hexdigest()
        r["entry_hash"] = prev
    forged = spark.createDataFrame([tuple(r[c] for c in log.columns) for r in rows], log.schema)
    assert audit.chain_report(forged, "tenant").first()["first_bad_seq"] == 11
    log.unpersist()


@pytest.mark.parametrize("cuts", [(4, 11), (5, 10), (1, 24)])
def test_chain_built_in_appends_is_the_chain_built_at_once(spark, folder, cuts):
    once = {tuple(r) for r in chain(spark, segment=5).select("seq", "segment", "payload", "prev_hash", "entry_hash").collect()}
    df = spark.range(25).select(F.lit("t").alias("tenant"), (F.col("id") * 7 % 25).alias("at"), F.col("id").alias("v"))
    log = None
    for low, high in zip((0, *cuts), (*cuts, 25)):
        part = df.where(F.col("at").between(low, high - 1))
        audit.chained(part, "tenant", [F.col("at")], F.floor(F.col("at") / 5), ["at", "v"], log).write.mode("append").parquet(folder + "/log")
        log = spark.read.parquet(folder + "/log")
    assert {tuple(r) for r in log.select("seq", "segment", "payload", "prev_hash", "entry_hash").collect()} == once
    assert audit.chain_report(log, "tenant").first()["valid"]


def hot_log(spark, log=None, low=0, high=2600, leaf=100):
    df = spark.range(low, high).select(F.lit("t").alias("tenant"), F.col("id").alias("at"), F.col("id").alias("v")).repartition(5)
    return audit.chained(df, "tenant", [F.col("at")], F.lit(7), ["at", "v"], log, leaf=leaf)


def test_a_hot_period_is_cut_into_leaves(spark, folder):
    """One period holds all entries: leaves of bounded size, in many tasks, the same log in appends that cut leaves anywhere."""
    once = hot_log(spark).collect()
    sizes = {}
    for r in once:
        sizes[r["leaf"]] = sizes.get(r["leaf"], 0) + 1
    assert sizes == {i: 100 for i in range(26)}
    log = None
    for low, high in ((0, 30), (30, 100), (100, 1234), (1234, 2600)):
        hot_log(spark, log, low, high).write.mode("append").parquet(folder + "/hot")
        log = spark.read.parquet(folder + "/hot")
    assert {tuple(r) for r in log.select(*once[0].asDict()).collect()} == {tuple(r) for r in once}
    assert audit.chain_report(log, "tenant").first().asDict() == {"tenant": "t", "entries": 2600, "first_bad_seq": None, "valid": True}
    changed = log.withColumn("payload", F.when(F.col("seq") == 777, F.lit("{}")).otherwise(F.col("payload")))
    assert audit.chain_report(changed, "tenant").first()["first_bad_seq"] == 777
    # A leaf rewritten as a whole, with all its hashes, still breaks the start of the next one.
    rows = [r.asDict() for r in sorted(once, key=lambda r: r["seq"])]
    prev = rows[300]["prev_hash"]
    for r in rows[300:400]:
        r["payload"], r["prev_hash"] = r["payload"].replace("v", "w"), prev
        prev = r["entry_hash"] = hashlib.sha256((prev + r["payload"]).encode()).hexdigest()
    forged = spark.createDataFrame([tuple(r.values()) for r in rows], log.select(*rows[0]).schema)
    assert audit.chain_report(forged, "tenant").first()["first_bad_seq"] == 401
    # With the default leaf, too, the one period is dealt out.
    assert hot_log(spark, leaf=audit.LEAF).select("leaf").distinct().count() == 3


@pytest.mark.parametrize("n", [1, 2, 3, 1024, 1025, 2600])
def test_inclusion_proofs(spark, n):
    log = spark.range(n).select(F.lit("t").alias("tenant"), F.lit(3).cast("bigint").alias("segment"), (F.col("id") + 11).alias("seq"), F.col("id").cast("string").alias("payload"))
    level = [hashlib.sha256(f"{i + 11}|{i}".encode()).hexdigest() for i in range(n)]
    leaves = level
    while len(level) > 1:
        level = ["".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        level = [hashlib.sha256(x.encode()).hexdigest() if len(x) > 64 else x for x in level]
    proofs = audit.inclusion_proofs(log.repartition(4), "tenant")
    other = F.sha2(F.lit("another entry"), 256)
    got = proofs.select("*", audit.proves(F.col("digest"), F.col("path"), F.col("root")).alias("ok"), audit.proves(other, F.col("path"), F.col("root")).alias("bad")).collect()
    assert sorted(r["seq"] for r in got) == list(range(11, n + 11))
    assert all(r["root"] == level[0] and r["ok"] and not r["bad"] and r["digest"] == leaves[r["seq"] - 11] and len(r["path"]) <= max(1, n - 1).bit_length() for r in got)


def test_late_entry_counts_to_the_open_segment(spark):
    log = spark.createDataFrame(chain(spark, segment=5).collect())
    late = spark.createDataFrame([("t", 3, 99)], "tenant string, at long, v long")
    new = audit.chained(late, "tenant", [F.col("at")], F.floor(F.col("at") / 5), ["at", "v"], log)
    assert [(r["seq"], r["segment"]) for r in new.collect()] == [(26, 4)]
    assert audit.chain_report(log.unionByName(new), "tenant").first()["valid"]


def test_consensus(spark):
    votes = spark.createDataFrame([("d", "a", "senior", "REVOKE", 1), ("d", "b", "JUNIOR", "MODIFY", 1), ("d", "a", "SENIOR", "REVOKE", 2), ("e", "a", "guest", "MODIFY", 1), ("e", "b", "SENIOR", "REVOKE", 1)], "decision_id string, analyst_id string, role string, correction_type string, seq int")
    want = spark.createDataFrame([("d", "revoke"), ("e", "MODIFY")], "decision_id string, target_type string")
    got = {r["decision_id"]: (r["consensus"], r["outcome"]) for r in audit.consensus(votes, want).collect()}
    assert got == {"d": (0.75, "APPLIED"), "e": (round(0.5 / 1.4, 4), "PENDING_CONSENSUS")}


def test_versions(spark):
    c = spark.createDataFrame([("D", 1, "MODIFY", "X"), ("D", 2, "CONFIRM", "X"), ("D", 3, "REVOKE", "X")], "root_id string, seq int, correction_type string, action_taken string")
    got = [(r["decision_id"], r["version"], r["supersedes"], r["action_taken"]) for r in audit.version_chain(c).orderBy("seq").collect()]
    assert got == [("D-CORR", 2, "D", "MODIFIED:X"), ("D-CORR-REV", 3, "D-CORR", "REVOKED:X")]


@pytest.mark.parametrize("shadow, ok", [((0.85, 0.82, 0.835), True), ((0.81, 0.78, 0.80), True), ((0.85, 0.70, 0.835), False)])
def test_promotion(spark, shadow, ok):
    live = (0.85, 0.82, 0.835)
    m = spark.createDataFrame([("m", n, s, v) for n, s, v in zip(("precision", "recall", "f1"), shadow, live)], "model string, metric string, shadow double, live double")
    row = audit.promotion(m).first()
    assert row["promoted"] is ok and (row["reasons"] == "") is ok


def test_recommendation_fallback_and_rules(spark):
    s = lambda rows: spark.createDataFrame(rows, "dimension string, item string, incidents bigint")
    quiet = report.recommendations(s([("total", "all", 10), ("type", "Other", 10)])).collect()
    assert [(r["rule"], r["priority"]) for r in quiet] == [("keep_monitoring", "MEDIUM")]
    busy = report.recommendations(s([("total", "all", 10), ("type", "Phishing", 4), ("type", "Ransomware", 1), ("technique", "T1190", 3)])).collect()
    assert [r["rule"] for r in busy] == ["email_training", "backup_recovery", "patch_management"]


def test_auc_and_threshold_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr("vigilframe.operators.running.RANGE_ROWS", 20)
    rng = np.random.RandomState(3)
    y = rng.rand(300) < 0.3
    x = np.round(rng.rand(300) + y * 0.3, 2)
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(x, y)], "s double, y boolean")
    row = evaluate.roc_threshold(evaluate.roc_points(df, F.col("s"), F.col("y")), 0.1).first()
    pos, neg = x[y], x[~y]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg)
    assert row["auc"] == pytest.approx(auc)
    best = max(((pos >= t).mean(), -(neg >= t).mean(), t) for t in set(x) if (neg >= t).mean() <= 0.1)
    assert (row["tpr"], row["fpr"], row["threshold"]) == pytest.approx((best[0], -best[1], best[2]))


def test_split_sizes(spark):
    df = spark.range(200).select("id", F.when(F.col("id") < 190, 0).when(F.col("id") < 198, 1).when(F.col("id") < 199, 2).otherwise(3).alias("label"))
    got = evaluate.stratified_split(df, "label", evaluate.hash_position("id"), "id").groupBy("label", "split").count().collect()
    sizes = {(r["label"], r["split"]): r["count"] for r in got}
    assert sizes[(0, "train")] == 133 and sizes[(0, "val")] == 28 and sizes[(0, "test")] == 29
    assert sizes[(1, "train")] == 6 and sizes[(1, "val")] == 1 and sizes[(1, "test")] == 1
    assert sizes[(2, "train")] == 1


def test_entropy_by_source(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("a", 2, "x"), ("a", 3, "x"), ("b", 9, "z")], "src string, port int, dst string")
    got = {r["src"]: (r["entropy"], r["destinations"]) for r in evaluate.entropy_by_source(df, "src", "port", "dst").collect()}
    assert got == {"a": (pytest.approx(1.5), 2), "b": (pytest.approx(0.0), 1)}


def test_forest_separates_outliers(spark):
    rng = np.random.RandomState(0)
    x = np.vstack([rng.normal(size=(1500, 2)), rng.normal(loc=8, size=(15, 2))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id bigint, a double, b double").repartition(5)
    model = models.fit_forest(df, "id", ["a", "b"], trees=40, size=128)
    got = {r["id"]: r["isolation_score"] for r in models.forest_scores(df, model).collect()}
    inside, outside = np.mean([got[i] for i in range(1500)]), np.mean([got[i] for i in range(1500, 1515)])
    assert outside > inside + 0.15 and sum(s > 0.5 for s in got.values()) == pytest.approx(0.05 * 1515, abs=6)
    again = models.fit_forest(df.repartition(2), "id", ["a", "b"], trees=40, size=128)
    assert again["offset"] == pytest.approx(model["offset"])


def test_tree_samples_have_the_asked_size(spark):
    s = models.tree_samples(spark.range(5000).withColumnRenamed("id", "row"), "row", 12, 64, 1)
    assert {r["count"] for r in s.groupBy("tree").count().collect()} == {64}


def test_sequence_readout_does_not_depend_on_partitions(spark):
    rng = np.random.RandomState(1)
    t = np.arange(10)
    data = [(i, [float(v) for v in np.column_stack([np.sin(t + i / 9), np.cos(t + i / 9)]).ravel() + rng.normal(scale=0.01, size=20)]) for i in range(120)]
    data += [(1000 + i, [float(v) for v in rng.normal(scale=3, size=20)]) for i in range(3)]
    df = spark.createDataFrame(data, "id int, sequence array<double>")
    normal = df.where("id < 1000")
    a = models.fit_sequences(normal.repartition(1), 10, 2, hidden=12, latent=6)
    b = models.fit_sequences(normal.repartition(6), 10, 2, hidden=12, latent=6)
    assert np.allclose(a["readout"], b["readout"], atol=1e-5)
    got = {r["id"]: r["sequence_score"] for r in models.sequence_scores(df, a).collect()}
    assert all(got[1000 + i] == 1.0 for i in range(3)) and np.mean([got[i] for i in range(120)]) < 0.9


def test_projection_equals_svd(spark):
    rng = np.random.RandomState(5)
    x = rng.normal(size=(80, 5)) * [5, 3, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    got = np.array([r["pc"] for r in models.projected_2d(df, "v").orderBy("id").collect()])
    _, _, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(x @ vt[:2].T), atol=1e-6)


def test_top_types_with_shares(spark):
    rows = [("total", "all", 40)] + [("type", f"t{i}", n) for i, n in enumerate([10, 10, 8, 6, 4, 2])] + [("actor", "a", 40)]
    stats = spark.createDataFrame(rows, "dimension string, item string, incidents long")
    got = [tuple(r) for r in report.top_shares(stats).orderBy(F.desc("incidents"), "item").collect()]
    assert got == [("t0", 10, 25.0), ("t1", 10, 25.0), ("t2", 8, 20.0), ("t3", 6, 15.0), ("t4", 4, 10.0)]
    assert report.top_shares(stats.where("dimension = 'type'")).where("share_pct <> 0").count() == 0
    assert report.top_shares(stats.limit(0)).count() == 0


def test_subsample_does_not_depend_on_the_order_of_ties(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(60)], "p int, v int")
    one = [r["v"] for r in evaluate.subsample(df, F.col("p"), 30).orderBy("v").collect()]
    two = [r["v"] for r in evaluate.subsample(df.orderBy(F.desc("v")).repartition(5), F.col("p"), 30).orderBy("v").collect()]
    assert one == two
