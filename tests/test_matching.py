import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.operators import attribution, federation, policy, route, similarity, tables
from vigilframe.session import plan_bytes, small_side


def vectors(spark, x, name="vec", ident="id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{ident} bigint, {name} array<float>")


@pytest.mark.parametrize("sizes", [{"broadcast_bytes": 0, "block_bytes": 7 * 72, "pivots": 5}, {"broadcast_bytes": 0, "block_bytes": 40 * 72}, {}])
def test_top_matches_equal_brute_force(spark, sizes):
    rng = np.random.RandomState(2)
    x, y = rng.normal(size=(60, 8)).astype(np.float32), rng.normal(size=(90, 8)).astype(np.float32)
    y[50] = y[3]
    y[7] = 0
    got = similarity.top_matches(
        vectors(spark, x), vectors(spark, y), 4, query_id="id", vector_id="id", query_vector="vec", vector="vec", **sizes
    ).collect()
    xn = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    norm = np.linalg.norm(y.astype(float), axis=1, keepdims=True)
    yn = np.divide(y.astype(float), norm, out=np.zeros(y.shape), where=norm > 0)
    sims = np.round(xn @ yn.T, 12)
    want = {(i, r + 1): j for i in range(60) for r, j in enumerate(sorted(range(90), key=lambda j: (-sims[i, j], j))[:4])}
    assert {(r["query_id"], r["rank"]): r["vector_id"] for r in got} == want


def brute_matches(x, y, k, same=False):
    norm = lambda m: np.divide(m.astype(float), np.linalg.norm(m.astype(float), axis=1, keepdims=True), out=np.zeros(m.shape), where=m.any(axis=1, keepdims=True))
    sims = np.round(norm(x) @ norm(y).T, 12)
    return {(i, r + 1): (j, sims[i, j]) for i in range(len(x)) for r, j in enumerate([j for j in np.lexsort((np.arange(len(y)), -sims[i])) if not (same and i == j)][:k])}


def clustered(rng, n, centres):
    out = (centres[rng.randint(len(centres), size=n)] + 0.05 * rng.normal(size=(n, centres.shape[1]))).astype(np.float32)
    out[::97] = 0
    out[1::50] = out[3]  # repeated vectors: ties go to the lower id
    return out


def test_metric_index_skips_most_pairs_and_stays_exact(spark):
    rng = np.random.RandomState(7)
    centres = rng.normal(size=(12, 16))
    x, y = clustered(rng, 150, centres), clustered(rng, 900, centres)
    q, v = vectors(spark, x).withColumnRenamed("vec", "q").withColumnRenamed("id", "query_id"), vectors(spark, y, "v", "vector_id")
    for k in (1, 5, 900, 1000):
        got = similarity.top_matches(q, v, k, query_vector="q", vector="v", broadcast_bytes=0, block_bytes=30 * 136, pivots=24).collect()
        want = brute_matches(x, y, k)
        assert {(r["query_id"], r["rank"]): r["vector_id"] for r in got} == {key: j for key, (j, _) in want.items()}
        assert all(abs(r["similarity"] - want[r["query_id"], r["rank"]][1]) < 1e-11 for r in got)
    # Pairs of queries and vectors that are compared, of all pairs (zero vectors are compared with everything).
    index = similarity.metric_index(v, 30, 24)
    assert index.rows.sum() == 900 and (index.rows / index.parts).max() <= 60
    rows = index.vectors.groupBy("block", "part").count()
    first = similarity.visits(index, q, 5)
    best = {i: s for (i, r), (_, s) in brute_matches(x, y, 5).items() if r == 5}
    kth = spark.createDataFrame([(i, float(s)) for i, s in best.items()], "query_id bigint, kth double")
    rest = similarity.visits(index, q.join(kth, "query_id"), 5, again=True)
    live = q.where(F.exists("q", lambda c: c != 0)).select("query_id")
    compared = first.unionByName(rest).join(live, "query_id", "left_semi").join(rows, ["block", "part"]).agg(F.sum("count")).first()[0]
    assert compared < 0.4 * live.count() * 900


def test_components_that_no_query_has_are_folded(spark, monkeypatch):
    rng = np.random.RandomState(9)
    x, y = np.zeros((30, 40)), rng.normal(size=(200, 40))
    x[:, :4] = rng.normal(size=(30, 4))
    x[7, 3], x[9], y[11], y[60] = 0, 0, 0, y[5]
    x, y = x.astype(np.float32), y.astype(np.float32)
    q, v = vectors(spark, x, "q", "query_id"), vectors(spark, y, "v", "vector_id")
    want = brute_matches(x, y, 5)

    def check(**sizes):
        got = similarity.top_matches(q, v, 5, query_vector="q", vector="v", **sizes).collect()
        assert {(r["query_id"], r["rank"]): r["vector_id"] for r in got} == {key: j for key, (j, _) in want.items()}
        assert all(abs(r["similarity"] - want[r["query_id"], r["rank"]][1]) < 1e-11 for r in got)

    check(broadcast_bytes=0, block_bytes=20 * 48, pivots=8)
    # Five numbers a vector are small enough to broadcast, forty are not.
    monkeypatch.setattr(similarity, "metric_index", None)
    check(broadcast_bytes=200 * 48)


def test_metric_index_with_a_floor_and_without_the_same_id(spark):
    rng = np.random.RandomState(8)
    x = clustered(rng, 300, rng.normal(size=(6, 10)))
    v = vectors(spark, x, "v", "vector_id")
    q = v.withColumnRenamed("v", "q").withColumnRenamed("vector_id", "query_id")
    sizes = {"query_vector": "q", "vector": "v", "exclude_same": True, "broadcast_bytes": 0, "block_bytes": 20 * 88, "pivots": 8}
    got = {(r["query_id"], r["rank"]): r["vector_id"] for r in similarity.top_matches(q, v, 3, **sizes).collect()}
    want = brute_matches(x, x, 3, same=True)
    assert got == {key: j for key, (j, _) in want.items()}
    near = {(r["query_id"], r["rank"]): r["vector_id"] for r in similarity.top_matches(q, v, 3, floor=0.9, **sizes).where("similarity >= 0.9").collect()}
    assert near == {key: j for key, (j, s) in want.items() if s >= 0.9}
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0])], "vector_id bigint, v array<float>")
    one = spark.createDataFrame([(5, [1.0, 0.0])], "query_id bigint, q array<float>")
    sizes = {**sizes, "exclude_same": False}
    assert [(r["vector_id"], r["similarity"]) for r in similarity.top_matches(one, zero, 1, **sizes).collect()] == [(1, 0.0)]
    assert similarity.top_matches(one, zero.limit(0), 1, **sizes).count() == 0


def test_dimension_check(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<float>")
    with pytest.raises(Exception, match="expected 3"):
        similarity.checked_vectors(df, "v", 3).collect()


def test_normalisation_keeps_zero(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(similarity.l2_normalized(F.col("v"))).collect()] == [pytest.approx([0.6, 0.8]), [0.0, 0.0]]


def test_router_paths(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    at = lambda s: F.lit(s).cast("timestamp")
    known = spark.createDataFrame([(1, "a", "HIGH", [1.0, 0.0]), (2, "b", "LOW", [0.0, 1.0]), (3, "c", "HIGH", [0.7, -0.7])], "vector_id bigint, fingerprint string, criticality string, embedding array<float>")
    cache = route.cached(known.where("fingerprint <> 'c'").select("fingerprint", F.concat(F.lit("D-"), "fingerprint").alias("decision_id"), F.lit(0.8).alias("risk_score"), at("2024-01-15").alias("cached_at")))
    old = route.cached(known.where("fingerprint = 'c'").select("fingerprint", F.lit("D-old").alias("decision_id"), F.lit(0.8).alias("risk_score"), at("2023-12-01").alias("cached_at")))
    events = spark.createDataFrame(
        [(10, "a", "HIGH", [0.0, 1.0]), (11, "z", "HIGH", [0.99, 0.01]), (12, "y", "HIGH", [0.01, 0.99]), (13, "x", "HIGH", [0.7, -0.71]), (14, "w", "LOW", [-1.0, -1.0]), (15, "v", None, [0.01, 0.99])],
        "evidence_id bigint, content_fingerprint string, criticality string, embedding array<float>",
    )
    got = {r["evidence_id"]: r for r in route.route(events, cache.unionByName(old), known, now).collect()}
    assert {k: (v["path"], v["reason"]) for k, v in got.items()} == {
        10: (1, "exact"), 11: (2, "fuzzy"), 12: (3, "criticality_mismatch"), 13: (3, "no_cached_decision"), 14: (3, "below_threshold"), 15: (2, "fuzzy"),
    }
    assert got[11]["risk_score"] == pytest.approx(0.76) and got[10]["risk_score"] == 0.8
    novel = route.route(events, cache, known, now, novel=lambda rest: rest.withColumn("decision_id", F.lit("new")))
    assert novel.where("decision_id = 'new'").count() == 3


def seq_embed(chain, dim=64):
    vec = np.zeros(dim, dtype=np.float32)
    for pos, t in enumerate(chain):
        h = hashlib.sha256(f"{t}_pos_{pos}".encode()).digest()
        v = np.random.RandomState(int.from_bytes(h[:4], "big")).normal(0, 1, dim).astype(np.float32)
        vec += v / np.linalg.norm(v) / (1 + pos)
    return vec / np.linalg.norm(vec)


def test_campaigns_equal_brute_force(spark):
    camps = [("alpha", ["T1595", "T1190", "T1059", "T1003"]), ("beta", ["T1566", "T1078"]), ("gamma", ["T1486"])]
    chains = [["T1595", "T1190"], ["T1566"], ["T1566", "T1078"], ["T9"], ["T1595", "T1190", "T1003"]]
    c = spark.createDataFrame([(i, n, s, {t: f"stop-{t}" for t in s}) for i, (n, s) in enumerate(camps)], "campaign_id bigint, name string, ttp_sequence array<string>, preventive_actions map<string,string>")
    got = {tuple(r["chain"]): r for r in attribution.campaign_matches(spark.createDataFrame([(x,) for x in chains + chains[:2]], "chain array<string>"), c).collect()}
    for chain in chains:
        sims = {n: float(seq_embed(chain) @ seq_embed(s)) for n, s in camps}
        name = max(sims, key=sims.get)
        if sims[name] < 0.7:
            assert tuple(chain) not in got
            continue
        seq = dict(camps)[name]
        want = None
        if len(chain) < len(seq):
            want = seq[seq.index(chain[-1]) + 1] if chain[-1] in seq and seq.index(chain[-1]) + 1 < len(seq) else seq[len(chain)]
        row = got[tuple(chain)]
        assert row["campaign"] == name and row["confidence"] == pytest.approx(sims[name], abs=1e-4)
        assert row["predicted_next"] == want and row["preventive_action"] == (f"stop-{want}" if want else None)


def test_text_embedding_equals_twin(spark):
    for s in ("hello", "x" * 500, "éa", ""):
        for prefix in (False, True):
            vec = np.zeros(384)
            for j, ch in enumerate(s[:384] if prefix else s):
                vec[j % 384] += ord(ch) / 128.0
            n = np.linalg.norm(vec)
            got = spark.createDataFrame([(s,)], "t string").select(attribution.text_embedding(F.col("t"), prefix_only=prefix)).first()[0]
            assert np.allclose(got, vec / n if n else vec)


def test_vote_shares(spark):
    docs = spark.createDataFrame([(1, "A", 0.9, 0.5), (1, "Unknown", 0.9, 0.9), (1, "B", None, None), (2, None, 0.9, 0.9)], "event_id int, actor string, trust double, similarity double")
    votes = spark.createDataFrame([(1, "A", 0.5), (2, "Unknown", 0.9)], "event_id int, actor string, confidence double")
    got = {(r["event_id"], r["actor"]): (r["share"], r["rank"]) for r in attribution.attribution_vote(docs, votes).collect()}
    total = 0.45 + 0.85 * 0.5 + 0.4
    assert got == {(1, "A"): (round(0.85 / total, 3), 1), (1, "B"): (round(0.425 / total, 3), 2)}


def test_indicators_expire_and_match(spark):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    ind = spark.createDataFrame(
        [("[ipv4-addr:value = '9.9.9.9']", "2024-01-09T00:00:00Z"), ("[domain-name:value = 'EVIL.com']", "2024-01-05T00:00:00Z"), ("[ipv4-addr:value = '9.9.9.9']", "2024-01-01T00:00:00Z"), ("[x]", "2024-01-09T00:00:00Z"), ("[domain-name:value = 'a.io']", "junk")],
        "pattern string, created string",
    )
    ev = spark.createDataFrame([(1, ["9.9.9.9", "evil.COM", "9.9.9.9"]), (2, ["a.io"]), (3, [])], "event_id int, vals array<string>")
    got = {r["event_id"]: (r["matches"], r["boost"]) for r in federation.matched(ev, F.col("vals"), ind, now).collect()}
    assert got == {1: (2, pytest.approx(0.15))}


def test_publish_needs_confidence_and_values(spark):
    ev = spark.createDataFrame([(1, "c2 9.9.9.9 " + "a" * 40, 0.9, "bob"), (2, "c2 9.9.9.9", 0.85, "eve"), (3, "10.0.0.1 only", 0.99, "joe")], "event_id int, text string, confidence double, user string")
    clean = federation.without_personal_fields(ev)
    assert "user" not in clean.columns
    got = federation.published(clean, "text", F.lit("2024-01-01T00:00:00Z"), "org").collect()
    assert {(r["event_id"], r["ioc_type"]) for r in got} == {(1, "ip"), (1, "hash_sha1")}


def test_policy_and_suspension(spark):
    profiles = spark.createDataFrame([("A1", ["Decision"], ["Execute"], ["data\\Audit.log"], "Evidence")], "agent_id string, forbidden_output_types array<string>, forbidden_actions array<string>, forbidden_paths array<string>, expected_output_schema string")
    calls = spark.createDataFrame([(1, "A1", "Decision", "execute", "x/data/audit.log", False), (2, "A1", "dict", "read", None, True), (3, "A9", "Decision", "execute", None, True)], "call_id int, agent_id string, output_type string, action string, path string, schema_ok boolean")
    v = policy.policy_violations(calls, profiles)
    assert {(r["violation"], r["severity"]) for r in v.collect()} == {("output_type_mismatch", "CRITICAL"), ("schema_validation_failure", "WARN"), ("forbidden_action", "CRITICAL"), ("forbidden_path_access", "CRITICAL")}
    seq = v.withColumn("seq", F.lit(5))
    assert policy.suspended(seq).first()["agent_id"] == "A1"
    assert policy.suspended(seq, spark.createDataFrame([("A1", 6)], "agent_id string, seq int")).count() == 0
    assert policy.suspended(seq.withColumn("agent_id", F.lit("A11"))).count() == 0


def test_upsert_freezes_first_values(spark):
    ch = spark.createDataFrame([(1, 1, "H1", "a", None), (1, 2, "H2", "b", "s"), (1, 3, None, None, "t"), (2, 1, "H9", "z", "q")], "decision_id int, seq int, hypothesis_id string, action_taken string, status string")
    got = {r["decision_id"]: r for r in tables.upserted(ch, "decision_id", "seq", tables.DECISION_MUTABLE).collect()}
    assert (got[1]["hypothesis_id"], got[1]["action_taken"], got[1]["status"]) == ("H1", None, "t")


def test_broadcast_only_when_small(spark):
    small = spark.range(10)
    big = spark.range(100_000_000)
    assert plan_bytes(big) > 64 * 1024 * 1024
    hinted = lambda df: "broadcast" in small_side(df)._jdf.queryExecution().logical().toString().lower()
    assert hinted(small) and not hinted(big)
