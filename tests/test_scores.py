import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe import params
from vigilframe.functions import features, scoring


def one(spark, column, **cols):
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "likelihood, crit, facing, conf, wanted",
    [(0.89, "CRITICAL", True, 0.91, round(0.89 * 0.91, 4)), (0.80, "LOW", False, 0.80, round(0.8 * 0.25 * 0.4 * 0.8, 4)), (2.0, "odd", None, 1.0, 0.2)],
)
def test_risk(spark, likelihood, crit, facing, conf, wanted):
    got = one(spark, scoring.risk(F.lit(likelihood), F.lit(crit), F.lit(facing).cast("boolean"), F.lit(conf)))
    assert got == pytest.approx(wanted, abs=1e-9)


def twin_posterior(n, u, c, rivals):
    lh = max(1, n) / (max(1, n) + 1) * (1 - u)
    num = lh * c
    den = num + sum(max(1, k) / (max(1, k) + 1) * 0.5 * rc for rc, k in rivals) + 0.3 * max(0.01, 1 - c)
    return round(max(0, min(1, num / den)), 4)


@pytest.mark.parametrize("n, u, c, rivals", [(0, 0.2, 0.9, []), (5, 0.1, 0.95, [(0.4, 0), (0.3, 3)]), (1, 1.0, 0.5, []), (2, 0.5, 1.0, [(0.9, 9)])])
def test_posterior(spark, n, u, c, rivals):
    arr = F.array(*[F.struct(F.lit(rc).alias("confidence"), F.array(*[F.lit("e")] * k).cast("array<string>").alias("evidence_refs")) for rc, k in rivals])
    if not rivals:
        arr = F.lit(None).cast("array<struct<confidence:double,evidence_refs:array<string>>>")
    got = one(spark, scoring.posterior(F.array(*[F.lit(i) for i in range(n)]) if n else F.array().cast("array<int>"), F.lit(u), F.lit(c), arr))
    assert got == pytest.approx(twin_posterior(n, u, c, rivals), abs=1e-9)


@pytest.mark.parametrize(
    "post, blast, gated, limits, wanted",
    [
        (0.9, 0.1, True, params.STANDARD, "HUMAN_GATE"), (0.5, 0.9, False, params.STANDARD, "MONITOR"), (0.51, 0.31, False, params.STANDARD, "HUMAN_GATE"),
        (0.51, 0.30, False, params.STANDARD, "AUTO_RESPOND"), (0.3, 0.0, True, params.DEMONSTRATION, "AUTO_RESPOND"),
    ],
)
def test_decision_rule(spark, post, blast, gated, limits, wanted):
    assert one(spark, scoring.decision_rule(F.lit(post), F.lit(blast), F.lit(gated), limits)) == wanted


@pytest.mark.parametrize(
    "kind, chain, wanted",
    [
        ("MONITOR", ["T1486"], "MONITOR"), ("HUMAN_GATE", ["T1486"], "ISOLATE_HOST (PENDING HUMAN APPROVAL)"), ("HUMAN_GATE", ["T1078"], "REVOKE_SESSION (PENDING HUMAN APPROVAL)"),
        ("HUMAN_GATE", ["x"], "NOTIFY_SOC (PENDING HUMAN APPROVAL)"), ("AUTO_RESPOND", ["T1190", "T1003"], "BLOCK_IP"), ("AUTO_RESPOND", ["T1003"], "REVOKE_SESSION"), ("AUTO_RESPOND", ["x"], "BLOCK_IP"),
    ],
)
def test_actions(spark, kind, chain, wanted):
    assert one(spark, scoring.response_action(F.lit(kind), F.array(*[F.lit(c) for c in chain]))) == wanted


def test_multiplier_priority(spark):
    m = lambda r, s, i: one(spark, scoring.threshold_multiplier(F.lit(r), F.lit(s), F.lit(i)))
    assert (m(False, True, "LOW"), m(True, True, "LOW"), m(True, False, "critical"), m(True, False, "?")) == (1.3, 0.7, 0.8, 1.0)


def test_decay_rejects_negative_hours(spark):
    assert one(spark, scoring.decayed(F.lit(0.91), F.lit(0.02), F.lit(4.0))) == pytest.approx(0.91 * math.exp(-0.08))
    with pytest.raises(Exception, match="negative"):
        one(spark, scoring.decayed(F.lit(0.9), F.lit(0.02), F.lit(-1.0)))


def test_boosts(spark):
    assert one(spark, scoring.hunt_boost(F.lit(0.0))) == 0.05 and one(spark, scoring.hunt_boost(F.lit(1.0))) == 0.15
    fed = [one(spark, scoring.federation_boost(F.lit(n))) for n in (0, 1, 2, 5)]
    assert fed == pytest.approx([0.0, 0.10, 0.15, 0.15])
    assert one(spark, scoring.boosted_in_order(F.lit(0.9), F.array(F.lit(0.0), F.lit(1.0)))) == 1.0


def test_counter_evidence_order(spark):
    got = one(spark, scoring.counter_evidence(F.lit(0.8765), {"scanner": F.lit(True), "whitelisted": F.lit(True), "valid_cert": F.lit(False)}))
    assert got == pytest.approx(round(round(0.8765 * 0.8, 4) * 0.85, 4), abs=1e-4)


def test_fusion_weights_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        scoring.fused_graph_score(F.lit(1), F.lit(1), F.lit(1), (0.5, 0.5, 0.5))


def test_primary_goal_ties(spark):
    rivals = F.array(F.struct(F.lit("a").alias("goal"), F.lit(0.6).alias("confidence")), F.struct(F.lit("b").alias("goal"), F.lit(0.6).alias("confidence")))
    assert one(spark, scoring.primary_goal(F.lit("own"), F.lit(0.6), rivals)) == "own"
    assert one(spark, scoring.primary_goal(F.lit("own"), F.lit(0.5), rivals)) == "a"


def test_reputation(spark):
    assert one(spark, scoring.reputation_score(F.lit(1), F.lit(1), F.lit(2), F.lit(4))) == 0.25
    assert one(spark, scoring.reputation_score(F.lit(0), F.lit(0), F.lit(0), F.lit(0))) == 0.0


def test_raw_features_on_texts(spark):
    rec = {"bytes": "52000", "src_port": "60000", "dst_port": "80", "protocol": "6", "flow_duration": "bad", "fwd_packets": "3"}
    df = spark.createDataFrame([rec])
    feats = features.raw_features({k: F.col(k) for k in rec})
    row = df.select(*[c.alias(n) for n, c in feats.items()]).first()
    assert list(feats) == features.RAW_FEATURES and len(feats) == 20
    assert (row["bytes"], row["protocol_tcp"], row["byte_rate"], row["packet_ratio"], row["is_high_port"], row["hour_of_day"], row["day_of_week"]) == (52000, 1, 0, 1, 1, 12, 2)
    assert row["port_entropy"] == pytest.approx((60000 - 80) / 60080)


def test_scaled_features_stay_in_range(spark):
    rec = {"bytes": "9e12", "src_port": "70000", "dst_port": "22", "protocol": "17", "flow_duration": "0", "fwd_packets": "1e9", "bwd_packets": "5"}
    df = spark.createDataFrame([rec])
    row = df.select(*[c.alias(n) for n, c in features.scaled_features({k: F.col(k) for k in rec}).items()]).first()
    assert len(row) == 20 and all(0 <= v <= 1 for v in row) and row["protocol_udp"] == 1 and row["hour_of_day"] == 0.5


def test_text_entropy(spark):
    for s in ("aab", "Abcd.example", "zzzz", ""):
        low = s.lower()
        p = np.array([low.count(c) for c in set(low)]) / max(len(low), 1)
        want = float(-(p * np.log2(p)).sum()) if len(low) else 0.0
        assert one(spark, features.text_entropy(F.lit(s))) == pytest.approx(want, abs=1e-12)


def test_roc_of_counts_beyond_bigint_products(spark):
    from vigilframe.operators import evaluate

    n = 5_000_000_000
    points = spark.createDataFrame([(0.9, n, 0, n, 0), (0.1, n, n, 0, n)], "score double, tp long, fp long, pos long, neg long")
    assert evaluate.roc_threshold(points, 0.05).first()["auc"] == 1.0
