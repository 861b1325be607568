import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.operators import graph


def random_graph(seed, n=9, m=26):
    rng = random.Random(seed)
    nodes = [(f"n{i}", round(rng.random(), 3)) for i in range(n)]
    edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice([0.2, 0.5, 0.9, 1.0]), k) for k in range(m)]
    return nodes, edges


def queue_walk(nodes, edges, origin):
    """Per-asset walk with a queue: a visit counts whenever it improves the node."""
    crit = dict(nodes)
    seen, total, todo = {}, 0.0, deque([(origin, 1.0)])
    while todo:
        node, p = todo.popleft()
        if seen.get(node, -1.0) >= p:
            continue
        seen[node] = p
        if node != origin:
            total += p * crit.get(node, 0.5)
        for s, d, w, _ in edges:
            if s == node and p * w > 0.01:
                todo.append((d, p * w))
    return round(min(1.0, total), 4)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_blast_equals_the_queue_walk(spark, seed):
    nodes, edges = random_graph(seed)
    nodes = [(n, c / 40) for n, c in nodes]
    n = spark.createDataFrame(nodes, "id string, criticality double")
    e = spark.createDataFrame(edges, "src string, dst string, weight double, ordinal bigint").repartition(3)
    got = {r["id"]: r["blast_radius"] for r in graph.blast_radius(n, e).collect()}
    assert got == pytest.approx({i: queue_walk(nodes, edges, i) for i, _ in nodes}, abs=1.01e-4)


def test_best_path_never_exceeds_visits(spark):
    nodes, edges = random_graph(5)
    n = spark.createDataFrame([(i, c / 40) for i, c in nodes], "id string, criticality double")
    e = spark.createDataFrame(edges, "src string, dst string, weight double, ordinal bigint")
    best = {r["id"]: r["blast_radius"] for r in graph.blast_radius(n, e, mode="best_path").collect()}
    visits = {r["id"]: r["blast_radius"] for r in graph.blast_radius(n, e).collect()}
    assert all(best[i] <= visits[i] + 1e-9 for i in best)


def test_blast_of_isolated_node_is_zero(spark):
    n = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "id string, criticality double")
    e = spark.createDataFrame([("b", "a", 0.4, 0)], "src string, dst string, weight double, ordinal bigint")
    assert {r["id"]: r["blast_radius"] for r in graph.blast_radius(n, e).collect()} == {"a": 0.0, "b": 0.4}


def test_reachable_and_at_risk(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("c", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "id string")
    assert {(r["id"], r["hops"]) for r in graph.reachable(e, start).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {r["id"] for r in graph.at_risk(e, start).collect()} == {"b", "c", "x"}


def test_attention_sums_to_one_per_destination(spark):
    rng = np.random.RandomState(0)
    n = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=3)]) for i in range(8)], "id int, h array<double>")
    e = spark.createDataFrame([(i, (i * 3 + k) % 8) for i in range(8) for k in range(3)], "src int, dst int")
    alpha = graph.attention(n, e, [0.1, 0.2, 0.3], [0.3, -0.2, 0.1])
    sums = [r[0] for r in alpha.groupBy("dst").agg(F.sum("alpha")).select("sum(alpha)").collect()]
    assert np.allclose(sums, 1)
    h = {r["id"]: np.array(r["h"]) for r in n.collect()}
    want = {i: np.zeros(3) for i in h}
    for r in alpha.collect():
        want[r["dst"]] = want[r["dst"]] + r["alpha"] * h[r["src"]]
    got = graph.attended(n, e, [0.1, 0.2, 0.3], [0.3, -0.2, 0.1], 3).collect()
    assert all(np.allclose(r["out"], want[r["id"]]) for r in got)


def test_sampling_is_bounded_and_repeatable(spark):
    e = spark.createDataFrame([("hub", f"n{i}") for i in range(500)] + [("a", "b")], "src string, dst string")
    one = {(r["src"], r["dst"]) for r in graph.sampled_neighbours(e, 10).collect()}
    two = {(r["src"], r["dst"]) for r in graph.sampled_neighbours(e.repartition(7), 10).collect()}
    assert one == two and sum(s == "hub" for s, _ in one) == 10 and ("a", "b") in one


def test_priority_and_status(spark):
    n = spark.createDataFrame([("a", "User", 0.9), ("b", "IP", 0.1), ("c", "Odd", 0.7)], "id string, type string, score double")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {r["id"]: r for r in graph.node_status(n, ids("a"), ids("a", "b")).collect()}
    assert [got[i]["status"] for i in "abc"] == ["compromised", "predicted", "suspicious"]
    assert [got[i]["severity"] for i in "abc"] == ["critical", "warning", "suspicious"]
    assert [got[i]["kind"] for i in "abc"] == ["service", "cloud", "server"]
    prio = n.select("id", graph.display_priority(F.lit("clean"), F.col("type"), F.col("id") == "b").alias("p"))
    assert {r["id"]: r["p"] for r in prio.collect()} == {"a": 6, "b": -5, "c": 10}


def test_edge_driven_nodes_keep_both_ends(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(20)], "id string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", i) for i in range(19)], "src string, dst string, k int")
    picked, kept = graph.edge_driven_nodes(nodes, edges, 5, 10, ["k"])
    ids = {r["id"] for r in picked.collect()}
    assert len(ids) == 10 and all({r["src"], r["dst"]} <= ids for r in kept.collect())


def test_node_feature_shapes(spark):
    df = spark.createDataFrame([("Technique", 0.3)], "t string, c double")
    f = df.select(graph.node_features(F.col("t"), F.col("c"), F.lit(0.5), F.lit(150.0), F.lit(None), F.lit("SWaT"))).first()[0]
    assert f == pytest.approx([3 / 8, 0.3, 0.5, 0.1, 0.0, 0, 0, 1])
    hot = df.select(graph.one_hot_features(F.col("t"), ["a", "Technique"], F.lit(0.5), F.lit(1500), F.lit(10))).first()[0]
    assert len(hot) == 19 and hot[1] == 1.0 and hot[16:] == [0.5, 1.0, 0.01]


def test_attention_of_far_apart_scores_sums_to_one(spark):
    n = spark.createDataFrame([("a", [2000.0]), ("b", [1.0]), ("c", [2.0]), ("x", [0.0]), ("y", [0.0])], "id string, h array<double>")
    e = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "src string, dst string")
    got = {(r["src"], r["dst"]): r["alpha"] for r in graph.attention(n, e, [1.0], [1.0]).collect()}
    assert got["a", "x"] == 1.0 and abs(got["b", "y"] + got["c", "y"] - 1) < 1e-12 and got["c", "y"] > got["b", "y"] > 0


def test_blast_radius_of_given_origins(spark):
    n = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", 0.25)], "id string, criticality double")
    e = spark.createDataFrame([("a", "b", 0.5, 1), ("b", "c", 0.5, 1), ("c", "a", 0.9, 1)], "src string, dst string, weight double, ordinal int")
    for mode in ("visits", "best_path"):
        got = {r["id"]: r["blast_radius"] for r in graph.blast_radius(n, e, mode, origins=spark.createDataFrame([("a",)], "id string")).collect()}
        assert got == {"a": 0.3125}


def test_next_hops_of_odd_edges_hold_nodes_only(spark):
    rows = [("a", "b", 0.5), ("b", "a", 0.9), ("a", "a", 0.3), (None, "a", 0.2), ("c", None, 0.1), ("c", "a", None), (None, None, 0.4), ("a", "b", None)]
    edges = spark.createDataFrame(rows, "src string, dst string, attention double")
    nodes = spark.createDataFrame([("a", 0.5, 0.1), ("b", -0.5, 0.2)], "id string, criticality double, fused double")
    out = graph.next_hops(edges, nodes, 3)
    best = {}
    for a, b, w in rows:
        for way in ((a, b), (b, a)):
            best[way] = max((x for x in (best.get(way), w) if x is not None), default=None)
    info = {"a": (0.5, 0.1), "b": (-0.5, 0.2)}
    score = lambda d, w: None if w is None else 0.5 * w * info.get(d, (0.5, 0.0))[0] + 0.5 * info.get(d, (0.5, 0.0))[1]
    want = {}
    for (a, b), w in best.items():
        want.setdefault(a, []).append((b, score(b, w)))
    got = {(r["node"], r["hop"]): (r["rank"], r["score"]) for r in out.collect()}
    assert len(got) == out.count() == sum(min(3, len(w)) for w in want.values())
    for a, hops in want.items():
        hops.sort(key=lambda h: (h[1] is None, -(h[1] or 0), h[0] or ""))
        for rank, (b, s) in enumerate(hops[:3], 1):
            assert got[a, b][0] == rank and (s is None) == (got[a, b][1] is None) and abs((s or 0) - (got[a, b][1] or 0)) < 1e-12
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
