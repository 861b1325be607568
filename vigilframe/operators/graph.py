"""Graph operators on node and edge tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe import params
from vigilframe.session import cut_lineage, small_side

PRUNE_BELOW = 0.01


def blast_radius(
    nodes: DataFrame,
    edges: DataFrame,
    mode: str = "visits",
    prune: float = PRUNE_BELOW,
    cap: float = 1.0,
    digits: int = 4,
    origins: DataFrame | None = None,
) -> DataFrame:
    """(id, blast_radius) of every node, or of the ids in ``origins``, all walks at once.

    ``nodes``: id, criticality. ``edges``: src, dst, weight in (0, 1], ordinal (the order
    of a node's outgoing edges). Each level joins the frontier with the edges
    and keeps visits that beat every earlier probability of (origin, node);
    every kept visit adds probability x criticality. ``mode='best_path'`` counts
    each node once, with its best path, and needs no visit order. The walk ends when
    no visit is left, as every kept visit has a higher probability than the one before.
    Edges are written once; a level is written once and read by the next.
    """
    if mode not in ("visits", "best_path"):
        raise ValueError(f"unknown mode {mode}")
    ordered = mode == "visits"
    hops = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"), *([F.col("ordinal").cast("bigint").alias("ordinal")] if ordered else []))
    hops = cut_lineage(hops)
    asked = nodes.select("id") if origins is None else origins.select("id").distinct()
    starts = asked.select(F.col("id").alias("origin"), F.col("id").alias("node"), F.lit(1.0).alias("prob"))
    frontier = starts.withColumn("path", F.array().cast("array<bigint>")) if ordered else starts
    levels = [starts]
    while True:
        path = [F.concat("path", F.array("ordinal")).alias("path")] if ordered else []
        reached = frontier.join(hops, frontier["node"] == hops["src"]).select(
            "origin", F.col("dst").alias("node"), (F.col("prob") * F.col("weight")).alias("prob"), *path
        ).where(F.col("prob") > prune)
        so_far = functools.reduce(DataFrame.unionByName, levels).groupBy("origin", "node").agg(F.max("prob").alias("_best"))
        if ordered:
            order = Window.partitionBy("origin", "node").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
            reached = reached.withColumn("_earlier", F.coalesce(F.max("prob").over(order), F.lit(-1.0)))
        else:
            reached = reached.groupBy("origin", "node").agg(F.max("prob").alias("prob")).withColumn("_earlier", F.lit(-1.0))
        kept = reached.join(so_far, ["origin", "node"], "left").where(F.col("prob") > F.greatest("_earlier", F.coalesce("_best", F.lit(-1.0))))
        frontier = cut_lineage(kept.select(*frontier.columns))
        if frontier.isEmpty():
            break
        levels.append(frontier.select("origin", "node", "prob"))
    counted = functools.reduce(DataFrame.unionByName, levels[1:], levels[0].limit(0)).where(F.col("origin") != F.col("node"))
    if not ordered:
        counted = counted.groupBy("origin", "node").agg(F.max("prob").alias("prob"))
    weighted = counted.join(nodes.select(F.col("id").alias("node"), "criticality"), "node", "left")
    total = weighted.groupBy("origin").agg(F.sum(F.col("prob") * F.coalesce("criticality", F.lit(0.5))).alias("_sum"))
    return asked.select("id").join(total, F.col("id") == F.col("origin"), "left").select(
        "id", F.round(F.least(F.lit(cap), F.coalesce("_sum", F.lit(0.0))), digits).alias("blast_radius")
    )


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, from one pass over the edges."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ways = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    return edges.select(*rest, F.explode(ways).alias("_way")).select("_way.src", "_way.dst", *rest).select(*edges.columns)


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends exist."""
    ids = nodes.select(F.col("id"))
    return edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, edges["dst"] == ids["id"], "left_semi")


def at_risk(edges: DataFrame, compromised: DataFrame) -> DataFrame:
    """Neighbours, in either direction, of the compromised ids that are not compromised."""
    both = undirected(edges.select("src", "dst"))
    ids = compromised.select(F.col("id"))
    near = both.join(ids, both["src"] == ids["id"], "left_semi").select(F.col("dst").alias("id")).distinct()
    return near.join(ids, "id", "left_anti")


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, hops) of every node reachable along directed edges from the start ids; the walk goes on until nothing new is found."""
    hops = cut_lineage(edges.select("src", "dst").distinct())
    levels = [cut_lineage(starts.select(F.col("id"), F.lit(0).cast("bigint").alias("hops")).distinct())]
    while not levels[-1].isEmpty():
        seen = functools.reduce(DataFrame.unionByName, levels)
        found = levels[-1].join(hops, levels[-1]["id"] == hops["src"]).select(F.col("dst").alias("id")).distinct()
        levels.append(cut_lineage(found.join(seen, "id", "left_anti").withColumn("hops", F.lit(len(levels)).cast("bigint"))))
    return functools.reduce(DataFrame.unionByName, levels)


def node_type_index(kind: Column) -> Column:
    expr = None
    for name, index in params.NODE_TYPE_INDEX.items():
        hit = F.lower(kind) == name
        expr = F.when(hit, F.lit(index)) if expr is None else expr.when(hit, F.lit(index))
    return expr.otherwise(F.lit(7))


def node_features(kind: Column, criticality: Column, cpu: Column, traffic: Column, connections: Column, source: Column) -> Column:
    """The 8-value node feature array."""
    default = lambda c, d: F.coalesce(c.cast("double"), F.lit(d))
    is_source = lambda s: F.when(source == s, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.array(
        node_type_index(kind) / F.lit(8.0),
        default(criticality, 0.5),
        default(cpu, 0.0),
        default(traffic, 0.0) / F.lit(1500.0),
        default(connections, 0.0) / F.lit(1000.0),
        is_source("LANL"),
        is_source("DAPT2020"),
        is_source("SWaT"),
    )


def one_hot_features(kind: Column, kinds: list[str], cpu: Column, traffic: Column, connections: Column) -> Column:
    """One-hot type (at least 16 wide) plus three scaled loads."""
    width = max(len(kinds), 16)
    hot = [F.when(kind == k, F.lit(1.0)).otherwise(F.lit(0.0)) for k in kinds] + [F.lit(0.0)] * (width - len(kinds))
    default = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return F.array(*hot, default(cpu), default(traffic) / F.lit(1500.0), default(connections) / F.lit(1000.0))


def node_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with label 1 when any incoming edge is labelled 1."""
    hit = edges.groupBy(F.col("dst").alias("id")).agg(F.max("label").alias("_label"))
    return nodes.join(hit, "id", "left").withColumn("label", F.coalesce("_label", F.lit(0)).cast("int")).drop("_label")


def _edge_weights(nodes: DataFrame, edges: DataFrame, source_weights, target_weights, slope: float) -> DataFrame:
    """Edges with ``_x``, the exponential of the leaky-ReLU score less the largest score of the destination, and the source vector ``h``.

    The score rises with the source's half, so a destination's largest score follows from the largest half among its sources:
    one aggregate of a number per destination, joined back.
    """

    def half(weights: list[float]) -> Column:
        terms = [F.element_at("h", i + 1) * F.lit(float(w)) for i, w in enumerate(weights)]
        return sum(terms[1:], terms[0])

    leaky = lambda c: F.when(c > 0, c).otherwise(c * F.lit(slope))
    src = nodes.select(F.col("id").alias("src"), half(source_weights).alias("_s"), "h")
    dst = nodes.select(F.col("id").alias("dst"), half(target_weights).alias("_t"))
    sourced = edges.join(src, "src")
    top = sourced.groupBy("dst").agg(F.max("_s").alias("_m")).join(dst, "dst")
    scored = sourced.join(top, "dst")
    return scored.withColumn("_x", F.exp(leaky(F.col("_s") + F.col("_t")) - leaky(F.col("_m") + F.col("_t")))).drop("_s", "_t", "_m")


def attention(nodes: DataFrame, edges: DataFrame, source_weights: list[float], target_weights: list[float], slope: float = 0.2) -> DataFrame:
    """Edges with ``alpha``: leaky-ReLU scores, softmax per destination.

    ``nodes``: id, h (already projected). The per-destination sum is a partial
    aggregate joined back, so a destination with many edges stays distributed.
    """
    weighted = _edge_weights(nodes, edges, source_weights, target_weights, slope).drop("h")
    total = weighted.groupBy("dst").agg(F.sum("_x").alias("_sum"))
    return weighted.join(total, "dst").withColumn("alpha", F.col("_x") / (F.col("_sum") + F.lit(1e-300))).drop("_x", "_sum")


def attended(nodes: DataFrame, edges: DataFrame, source_weights: list[float], target_weights: list[float], dim: int, slope: float = 0.2) -> DataFrame:
    """(id, out): attention-weighted sum of the source vectors per destination.

    Numerator and denominator come from the same aggregate, so every edge is
    read once.
    """
    weighted = _edge_weights(nodes, edges, source_weights, target_weights, slope)
    sums = weighted.groupBy(F.col("dst").alias("id")).agg(
        F.sum("_x").alias("_sum"), *[F.sum(F.col("_x") * F.element_at("h", i + 1)).alias(f"_o{i}") for i in range(dim)]
    )
    out = F.array(*[F.col(f"_o{i}") / (F.col("_sum") + F.lit(1e-300)) for i in range(dim)])
    zero = F.array(*[F.lit(0.0)] * dim)
    return nodes.select("id").join(sums.select("id", out.alias("out")), "id", "left").withColumn("out", F.coalesce("out", zero))


def sampled_neighbours(edges: DataFrame, size: int = 10, seed: int = 42) -> DataFrame:
    """At most ``size`` outgoing edges per node, picked by a hash rank."""
    rank = Window.partitionBy("src").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("src").cast("string"), F.col("dst").cast("string"))), "dst")
    return edges.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= size).drop("_rank")


def neighbour_mean(nodes: DataFrame, edges: DataFrame, dim: int) -> DataFrame:
    """(id, self, neighbours): own vector and the mean over outgoing neighbours.

    A node without neighbours uses its own vector.
    """
    dst = nodes.select(F.col("id").alias("dst"), F.col("h").alias("_n"))
    means = edges.join(dst, "dst").groupBy(F.col("src").alias("id")).agg(
        F.array(*[F.avg(F.element_at("_n", i + 1)) for i in range(dim)]).alias("_mean")
    )
    return nodes.join(means, "id", "left").select("id", F.col("h").alias("self"), F.coalesce("_mean", "h").alias("neighbours"))


def centroid_anomaly(nodes: DataFrame, vector: str, benign: Column, dim: int) -> DataFrame:
    """Add ``anomaly``: one minus the cosine to the centroid of the benign rows, in [0, 1]."""
    row = nodes.where(benign).agg(*[F.avg(F.element_at(vector, i + 1).cast("double")).alias(f"c{i}") for i in range(dim)]).first()
    if row is None or row["c0"] is None:
        return nodes.withColumn("anomaly", F.lit(0.0))
    from vigilframe.operators.similarity import cosine

    centre = F.array(*[F.lit(float(row[f"c{i}"])) for i in range(dim)])
    return nodes.withColumn("anomaly", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - cosine(F.col(vector), centre))))


def drift(now: DataFrame, base: DataFrame) -> DataFrame:
    """(id, drift): distance from the baseline vector over the largest distance."""
    gap = F.sqrt(F.aggregate(F.zip_with("h", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, v: a + v))
    dist = now.join(base.select("id", F.col("h").alias("b")), "id").select("id", gap.alias("_d"))
    top = dist.agg(F.max("_d")).first()[0] or 0.0
    return dist.select("id", (F.col("_d") / F.lit(float(top) + 1e-8)).alias("drift"))


def next_hops(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, hop, score, rank): best neighbours by attention, criticality and fused score.

    ``edges``: src, dst, attention. ``nodes``: id, criticality, fused.
    """
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    # Both directions of a pair have the same best attention, so it is taken once, before the pair is turned around; a loop is one pair.
    best = edges.groupBy(F.least(way("src", "dst"), way("dst", "src")).alias("_way")).agg(F.max("attention").alias("attention"))
    ways = F.explode(F.array_distinct(F.array(way("_way.src", "_way.dst"), way("_way.dst", "_way.src"))))
    pairs = best.select(ways.alias("_way"), "attention").select("_way.src", "_way.dst", "attention")
    info = nodes.select(F.col("id").alias("dst"), "criticality", "fused")
    # Nodes are hashed, not both sides sorted: beside the sort of the window, a task holds its nodes only and not its edges once more.
    scored = pairs.join(info.hint("shuffle_hash"), "dst", "left").withColumn(
        "score",
        F.lit(0.5) * F.col("attention") * F.coalesce("criticality", F.lit(0.5)) + F.lit(0.5) * F.coalesce("fused", F.lit(0.0)),
    )
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return (
        scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
        .select(F.col("src").alias("node"), F.col("dst").alias("hop"), "score", "rank")
    )


def edge_driven_nodes(nodes: DataFrame, edges: DataFrame, edge_limit: int, node_limit: int, edge_order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the first edges, all their ends, and other nodes up to the limit."""
    kept = edges.orderBy(*edge_order).limit(edge_limit)
    ends = touched_nodes(kept)
    core = nodes.join(ends, "id", "left_semi").withColumn("core", F.lit(True))
    others = nodes.join(ends, "id", "left_anti").withColumn("core", F.lit(False))
    picked = core.unionByName(others).orderBy(F.desc("core"), "id").limit(node_limit)
    return core.unionByName(picked.where(~F.col("core"))), kept


def node_status(nodes: DataFrame, compromised: DataFrame, predicted: DataFrame) -> DataFrame:
    """Add status, kind and severity from two id sets and the graph score."""
    c = compromised.select("id").distinct().withColumn("_c", F.lit(True))
    p = predicted.select("id").distinct().withColumn("_p", F.lit(True))
    kinds = F.create_map(*[F.lit(x) for kv in params.NODE_KIND.items() for x in kv])
    status = (
        F.when(F.col("_c").isNotNull(), "compromised")
        .when(F.col("_p").isNotNull(), "predicted")
        .when(F.col("score") > 0.6, "suspicious")
        .otherwise("clean")
    )
    severity = F.when(F.col("status") == "compromised", "critical").when(F.col("status") == "predicted", "warning").otherwise(F.col("status"))
    return (
        nodes.join(c, "id", "left").join(p, "id", "left")
        .withColumn("status", status)
        .withColumn("kind", F.coalesce(F.try_element_at(kinds, F.col("type")), F.lit("server")))
        .withColumn("severity", severity)
        .drop("_c", "_p")
    )


def display_priority(severity: Column, kind: Column, on_path: Column) -> Column:
    base = (
        F.when(severity == "critical", 1).when(severity == "suspicious", 2).when(severity == "warning", 3)
        .when(kind.isin("ThreatGroup", "Campaign"), 4).when(kind.isin("Computer", "IP", "Asset", "OTSensor"), 5)
        .when(kind == "User", 6).otherwise(10)
    )
    return base - F.when(on_path, 10).otherwise(0)


def graph_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(group_name, data): one JSON element per node and edge."""
    n = nodes.select(F.lit("nodes").alias("group_name"), F.to_json(F.struct(*sorted(nodes.columns))).alias("data"))
    named = edges.withColumn("id", F.concat_ws("->", F.col("src").cast("string"), F.col("dst").cast("string")))
    e = named.select(F.lit("edges").alias("group_name"), F.to_json(F.struct(*sorted(named.columns))).alias("data"))
    return n.unionByName(e)


def merged_edges(edges: DataFrame, seq: str) -> DataFrame:
    """One edge per (src, dst, relation) with the newest properties; event edges are just appended."""
    keys = ["src", "dst", "relation"]
    rest = [c for c in edges.columns if c not in keys]
    newest = edges.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row"))
    return newest.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def touched_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def neighbour_layer(nodes: DataFrame, edges: DataFrame, dim: int, weights: list[list[float]]) -> DataFrame:
    """(id, out): own vector and neighbour mean side by side, a linear map, unit length, then negative values cut to 0.

    ``weights`` has one row of 2 x dim values per output. A node that was not there in training gets its vector the same way.
    """
    from vigilframe.operators.similarity import l2_normalized

    rows = neighbour_mean(nodes, edges, dim).select("id", F.concat("self", "neighbours").alias("_x"))
    linear = F.array(*[sum((F.element_at("_x", i + 1) * F.lit(float(w)) for i, w in enumerate(row)), F.lit(0.0)) for row in weights])
    return rows.select("id", F.transform(l2_normalized(linear), lambda v: F.greatest(v, F.lit(0.0))).alias("out"))


def display_groups(nodes: DataFrame, core: int = 15) -> DataFrame:
    """Add ``place`` in display order and ``core``: whether the node is among the first ``core``.

    ``nodes``: id, priority. Only the first rows are ranked; the rest is background without a place.
    """
    first = nodes.orderBy("priority", "id").limit(core)
    ranked = first.select("id", F.row_number().over(Window.orderBy("priority", "id")).alias("place"))  # at most ``core`` rows
    return nodes.join(small_side(ranked), "id", "left").withColumn("core", F.col("place").isNotNull())
