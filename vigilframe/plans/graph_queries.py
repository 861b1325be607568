"""Queries: graph sources and graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe import params
from vigilframe.functions import scoring
from vigilframe.operators import evaluate, graph, models
from vigilframe.plans import derived as d
from vigilframe.plans import score_queries
from vigilframe.plans.registry import Tables, query
from vigilframe.session import cut_lineage, scratch_path, spread
from vigilframe.sources import graphs, writers

# Suppliers reach parts through their line items, parts reach their brand.
_E1_SQL = "SELECT l_suppkey AS s, l_partkey AS p, sum(l_quantity) / (sum(l_quantity) + 60) AS w, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label, min(l_orderkey) AS first_order FROM lineitem GROUP BY l_suppkey, l_partkey"


def _supply_edges(t: Tables) -> DataFrame:
    q = F.sum("l_quantity")
    return t.lineitem.groupBy("l_suppkey", "l_partkey").agg(
        (q / (q + 60)).alias("weight"), F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("label"), F.min("l_orderkey").alias("first_order")
    ).select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"),
        "weight", F.col("l_partkey").alias("ordinal"), "label", "first_order",
    )


def _brand_edges(t: Tables) -> DataFrame:
    return t.part.select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("src"), F.col("p_brand").alias("dst"), (F.col("p_size") / F.lit(100.0)).alias("weight"),
        F.lit(0).cast("bigint").alias("ordinal"), F.lit(0).alias("label"), F.lit(0).cast("bigint").alias("first_order"),
    )


def _nodes(t: Tables) -> DataFrame:
    s = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit(0.5).alias("criticality"), F.lit("Computer").alias("type"), F.col("s_acctbal").alias("load"))
    p = t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), ((F.col("p_partkey") % 10) / F.lit(1e4)).alias("criticality"), F.lit("Asset").alias("type"), F.col("p_retailprice").alias("load"))
    b = t.part.select(F.col("p_brand").alias("id")).distinct().select("id", F.lit(0.002).alias("criticality"), F.lit("ThreatGroup").alias("type"), F.lit(0.0).alias("load"))
    return s.unionByName(p).unionByName(b)


_NODES_SQL = (
    "SELECT concat('s', CAST(s_suppkey AS STRING)) AS id, 5e-1 AS criticality, 'Computer' AS type, s_acctbal AS load FROM supplier UNION ALL "
    "SELECT concat('p', CAST(p_partkey AS STRING)), (p_partkey % 10) / 1e4, 'Asset', p_retailprice FROM part UNION ALL SELECT DISTINCT p_brand, 2e-3, 'ThreatGroup', 0e0 FROM part"
)
_BLAST_SQL = f"""WITH e1 AS ({_E1_SQL}), e2 AS (SELECT p_partkey AS p, p_brand AS b, p_size / 100e0 AS w FROM part), l1 AS (SELECT * FROM e1 WHERE w > 0.01),
 l2 AS (SELECT s, b, p, l1.w * e2.w AS pr FROM l1 JOIN e2 USING (p) WHERE l1.w * e2.w > 0.01), rec AS (SELECT *, max(pr) OVER (PARTITION BY s, b ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM l2),
 c AS (SELECT concat('s', CAST(s AS STRING)) AS id, w * (p % 10) / 1e4 AS v FROM l1 UNION ALL {{brand}} UNION ALL SELECT concat('p', CAST(p AS STRING)), w * 2e-3 FROM e2 WHERE w > 0.01),
 t AS (SELECT id, sum(v) AS v FROM c GROUP BY id), n AS ({_NODES_SQL})
 SELECT n.id, round(least(1e0, coalesce(v, 0e0)), 6) AS blast_radius FROM n LEFT JOIN t USING (id)"""


@query("G-03", _BLAST_SQL.format(brand="SELECT concat('s', CAST(s AS STRING)), pr * 2e-3 FROM rec WHERE prev IS NULL OR pr > prev"))
def blast_radius(t: Tables) -> DataFrame:
    edges = _supply_edges(t).unionByName(_brand_edges(t))
    return graph.blast_radius(_nodes(t).select("id", "criticality"), edges, digits=6)


@query("G-03", _BLAST_SQL.format(brand="SELECT concat('s', CAST(s AS STRING)), max(pr) * 2e-3 FROM l2 GROUP BY s, b"))
def blast_radius_best_path(t: Tables) -> DataFrame:
    edges = _supply_edges(t).unionByName(_brand_edges(t))
    return graph.blast_radius(_nodes(t).select("id", "criticality"), edges, mode="best_path", digits=6)


@query(
    "G-02 A-20",
    f"""WITH e AS ({_E1_SQL}), lab AS (SELECT concat('p', CAST(p AS STRING)) AS id, max(label) AS l FROM e GROUP BY p), n AS ({_NODES_SQL}),
    touched AS (SELECT DISTINCT concat('s', CAST(s AS STRING)) AS id FROM e WHERE label = 1 UNION SELECT concat('p', CAST(p AS STRING)) FROM e WHERE label = 1)
    SELECT id, CAST(coalesce(l, 0) AS INT) AS label, id IN (SELECT id FROM touched) AS touched FROM n LEFT JOIN lab USING (id)""",
)
def node_labels(t: Tables) -> DataFrame:
    e = _supply_edges(t)
    hit = graph.touched_nodes(e.where("label = 1")).withColumn("touched", F.lit(True))
    labelled = graph.node_labels(_nodes(t).select("id"), e).join(hit, "id", "left")
    return labelled.select("id", "label", F.coalesce("touched", F.lit(False)).alias("touched"))


@query(
    "G-01",
    f"SELECT id, CASE type WHEN 'Computer' THEN 0 WHEN 'Asset' THEN 7 / 8e0 ELSE 5 / 8e0 END AS f0, round(criticality, 6) AS f1, round(load / 1500, 6) AS f3, CASE WHEN type = 'Computer' THEN 1e0 ELSE 0e0 END AS f5 FROM ({_NODES_SQL})".replace("THEN 0 WHEN", "THEN 0e0 WHEN"),
)
def node_features(t: Tables) -> DataFrame:
    n = _nodes(t)
    feats = graph.node_features(F.col("type"), F.col("criticality"), F.lit(None).cast("double"), F.col("load"), F.lit(None).cast("double"), F.when(F.col("type") == "Computer", "LANL"))
    n = n.withColumn("f", feats)
    at = lambda i: F.element_at("f", i + 1)
    return n.select("id", at(0).alias("f0"), F.round(at(1), 6).alias("f1"), F.round(at(3), 6).alias("f3"), at(5).alias("f5"))


_H_SQL = f"SELECT id, criticality * 10 AS a, load / 1000 AS b, length(id) / 10e0 AS c FROM ({_NODES_SQL})"


def _vectors(t: Tables) -> DataFrame:
    return _nodes(t).select("id", F.array(F.col("criticality") * 10, F.col("load") / 1000, F.length("id") / F.lit(10.0)).alias("h"))


@query(
    "G-04",
    f"""WITH e AS (SELECT concat('s', CAST(s AS STRING)) AS src, concat('p', CAST(p AS STRING)) AS dst FROM ({_E1_SQL})), h AS ({_H_SQL}),
    x AS (SELECT src, dst, hs.a AS a, hs.b AS b, hs.c AS c, (hs.a * 3e-1 + hs.b * -2e-1 + hs.c * 5e-1) + (hd.a * 1e-1 + hd.b * -4e-1 + hd.c * 2e-1) AS r FROM e JOIN h hs ON src = hs.id JOIN h hd ON dst = hd.id),
    y AS (SELECT *, exp(CASE WHEN r > 0 THEN r ELSE r * 2e-1 END) AS ex FROM x), z AS (SELECT *, ex / sum(ex) OVER (PARTITION BY dst) AS alpha FROM y),
    o AS (SELECT dst AS id, sum(alpha * a) AS o1, sum(alpha * b) AS o2, sum(alpha * c) AS o3 FROM z GROUP BY dst)
    SELECT h.id, round(coalesce(o1, 0e0), 5) AS o1, round(coalesce(o2, 0e0), 5) AS o2, round(coalesce(o3, 0e0), 5) AS o3 FROM h LEFT JOIN o USING (id)""",
)
def graph_attention(t: Tables) -> DataFrame:
    h = _vectors(t)
    out = graph.attended(h, _supply_edges(t).select("src", "dst"), [0.3, -0.2, 0.5], [0.1, -0.4, 0.2], 3)
    return out.select("id", *[F.round(F.element_at("out", i + 1), 5).alias(f"o{i + 1}") for i in range(3)])


@query(
    "G-05",
    f"""WITH e AS (SELECT concat('s', CAST(s AS STRING)) AS src, concat('p', CAST(p AS STRING)) AS dst FROM ({_E1_SQL})), h AS ({_H_SQL}), m AS (SELECT src AS id, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM e JOIN h ON dst = id GROUP BY src)
    SELECT h.id, round(coalesce(m.a, h.a), 6) AS m1, round(coalesce(m.b, h.b), 6) AS m2, round(coalesce(m.c, h.c), 6) AS m3 FROM h LEFT JOIN m USING (id)""",
)
def neighbour_means(t: Tables) -> DataFrame:
    m = graph.neighbour_mean(_vectors(t), _supply_edges(t).select("src", "dst"), 3)
    return m.select("id", *[F.round(F.element_at("neighbours", i + 1), 6).alias(f"m{i + 1}") for i in range(3)])


@query(
    "G-05",
    f"""WITH e AS (SELECT concat('s', CAST(s AS STRING)) AS src, concat('p', CAST(p AS STRING)) AS dst FROM ({_E1_SQL})),
    r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY md5(concat('42|', src, '|', dst)), dst) AS rk FROM e) SELECT src, dst FROM r WHERE rk <= 10""",
)
def sampled_neighbours(t: Tables) -> DataFrame:
    return graph.sampled_neighbours(_supply_edges(t).select("src", "dst"), 10)


_U_SQL = "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings"


@query(
    "G-06",
    f"""WITH u AS ({_U_SQL}), c AS (SELECT i, avg(x) AS c FROM u WHERE label < 5 GROUP BY i)
    SELECT vec_id, round(greatest(0e0, least(1e0, 1 - sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))))), 5) AS anomaly FROM u JOIN c USING (i) GROUP BY vec_id""",
)
def centroid_anomaly(t: Tables) -> DataFrame:
    out = graph.centroid_anomaly(t.embeddings, "embedding", F.col("label") < 5, 64)
    return out.select("vec_id", F.round("anomaly", 5).alias("anomaly"))


@query(
    "G-07",
    f"""WITH u AS ({_U_SQL}), dd AS (SELECT vec_id, sqrt(sum((x - x * (vec_id % 5) / 4e0) * (x - x * (vec_id % 5) / 4e0))) AS g FROM u GROUP BY vec_id)
    SELECT vec_id, round(g / (SELECT max(g) + 1e-8 FROM dd), 5) AS drift FROM dd""",
)
def vector_drift(t: Tables) -> DataFrame:
    h = F.transform("embedding", lambda x: x.cast("double"))
    now = t.embeddings.select(F.col("vec_id").alias("id"), h.alias("h"))
    base = t.embeddings.select(F.col("vec_id").alias("id"), F.transform(h, lambda x: x * (F.col("vec_id") % 5) / F.lit(4.0)).alias("h"))
    return graph.drift(now, base).select(F.col("id").alias("vec_id"), F.round("drift", 5).alias("drift"))


@query(
    "G-08",
    f"""WITH n AS ({_NODES_SQL}), x AS (SELECT id, 4e-1 * least(1e0, abs(load) / 10007) + 3e-1 * criticality + 3e-1 * (length(id) / 11e0) AS fused FROM n)
    SELECT id, round(fused, 6) AS fused, round(least(7e-1 + 1e-1 * fused, 1e0), 6) AS confidence FROM x""",
)
def fused_graph_scores(t: Tables) -> DataFrame:
    fused = scoring.fused_graph_score(F.least(F.lit(1.0), F.abs("load") / 10007), F.col("criticality"), F.length("id") / F.lit(11.0))
    n = _nodes(t).withColumn("fused", fused)
    return n.select("id", F.round("fused", 6).alias("fused"), F.round(F.least(F.lit(0.7) + F.lit(0.1) * F.col("fused"), F.lit(1.0)), 6).alias("confidence"))


@query("G-09")
def embedding_projection(t: Tables) -> DataFrame:
    p = models.projected_2d(t.embeddings, "embedding")
    return p.select("vec_id", F.round(F.abs(F.element_at("pc", 1)), 4).alias("pc1"), F.round(F.abs(F.element_at("pc", 2)), 4).alias("pc2"))


@query(
    "G-10",
    f"""WITH e AS ({_E1_SQL}), b AS (SELECT concat('s', CAST(s AS STRING)) AS x, concat('p', CAST(p AS STRING)) AS y FROM e), u AS (SELECT x, y FROM b UNION ALL SELECT y, x FROM b),
    c AS (SELECT concat('s', CAST(s_suppkey AS STRING)) AS id FROM supplier WHERE s_suppkey % 25 = 3 UNION ALL SELECT concat('p', CAST(p_partkey AS STRING)) FROM part WHERE p_partkey % 500 = 1)
    SELECT DISTINCT y AS id FROM u WHERE x IN (SELECT id FROM c) AND y NOT IN (SELECT id FROM c)""",
)
def at_risk_nodes(t: Tables) -> DataFrame:
    s = t.supplier.where("s_suppkey % 25 = 3").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    p = t.part.where("p_partkey % 500 = 1").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return graph.at_risk(_supply_edges(t), s.unionByName(p))


@query(
    "G-10",
    f"""WITH e AS ({_E1_SQL}), s AS (SELECT s_suppkey AS s FROM supplier WHERE s_suppkey % 50 = 7), p AS (SELECT DISTINCT p FROM e WHERE s IN (SELECT s FROM s))
    SELECT concat('s', CAST(s AS STRING)) AS id, CAST(0 AS BIGINT) AS hops FROM s UNION ALL SELECT concat('p', CAST(p AS STRING)), 1 FROM p
    UNION ALL SELECT DISTINCT p_brand, CAST(2 AS BIGINT) FROM part WHERE p_partkey IN (SELECT p FROM p)""",
)
def reachable_nodes(t: Tables) -> DataFrame:
    starts = t.supplier.where("s_suppkey % 50 = 7").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    edges = _supply_edges(t).select("src", "dst").unionByName(_brand_edges(t).select("src", "dst"))
    return graph.reachable(edges, starts)


@query("G-11 G-05 G-02 A-12 A-19 A-27")
def node_classifier(t: Tables) -> DataFrame:
    """Class-weighted classifier on neighbour features; metrics of the test split."""
    bad = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1) & (F.col("l_quantity") > 25)
    marked = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.max(F.when(bad, 1).otherwise(0)).alias("label"))
    e = marked.select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), "label"
    )
    swapped = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    h = _vectors(t)
    means = graph.neighbour_mean(h, swapped, 3)
    labelled = graph.node_labels(means, e)
    weights = evaluate.class_weights(labelled, "label").select("label", "weight")
    rows = evaluate.stratified_split(labelled.join(weights, "label"), "label", evaluate.hash_position("id"), "id")
    rows = cut_lineage(rows)
    features = F.concat("self", "neighbours")
    fitted = models.neighbour_classifier(rows.where("split = 'train'"), features, "label", "weight")
    from pyspark.ml.functions import array_to_vector

    test = fitted.transform(rows.where("split = 'test'").withColumn("_features", array_to_vector(features)))
    metrics = evaluate.confusion(test, F.col("label") == 1, F.col("prediction") == 1)
    return metrics.select("tp", "fp", "fn", "tn", *[F.round(c, 4).alias(c) for c in ("accuracy", "precision", "recall", "f1", "fpr")])


@query(
    "G-12 A-25 S-38",
    f"""WITH e AS ({_E1_SQL}), j AS (SELECT 'nodes' AS group_name, concat('{{"criticality":', CAST(CAST(criticality AS DECIMAL(12, 6)) AS STRING), ',"id":"', id, '","type":"', type, '"}}') AS data FROM ({_NODES_SQL})
      UNION ALL SELECT 'edges', concat('{{"dst":"p', CAST(p AS STRING), '","id":"s', CAST(s AS STRING), '->p', CAST(p AS STRING), '","label":', CAST(label AS STRING), ',"src":"s', CAST(s AS STRING), '"}}') FROM e)
    SELECT group_name, data FROM j""",
)
def graph_elements(t: Tables) -> DataFrame:
    n = _nodes(t).select("id", F.col("criticality").cast("decimal(12, 6)").alias("criticality"), "type")
    return graph.graph_elements(n, _supply_edges(t).select("src", "dst", "label"))


@query(
    "S-38 A-25",
    f"SELECT (SELECT count(*) FROM ({_NODES_SQL})) AS node_count, (SELECT count(*) FROM ({_E1_SQL})) AS edge_count",
)
def graph_dump_counts(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "graph")
    writers.write_graph(_nodes(t), _supply_edges(t), path)
    nodes, edges = t.spark.read.json(f"{path}/nodes"), t.spark.read.json(f"{path}/edges")
    n = nodes.agg(F.count("id").alias("node_count")).withColumn("k", F.lit(1))
    e = edges.agg(F.count("src").alias("edge_count")).withColumn("k", F.lit(1))
    return n.join(e, "k").drop("k")


@query(
    "J-12 J-18",
    f"""WITH e AS ({_E1_SQL}) SELECT count(*) AS kept, CAST(sum(s) AS BIGINT) AS src_sum, CAST(sum(p) AS BIGINT) AS dst_sum FROM e WHERE s IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000) AND p IN (SELECT p_partkey FROM part WHERE p_size > 20)""",
)
def edges_with_known_ends(t: Tables) -> DataFrame:
    ids = t.supplier.where("s_acctbal > 3000").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id")).unionByName(
        t.part.where("p_size > 20").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    )
    kept = graph.known_edges(_supply_edges(t), ids)
    num = lambda c: F.sum(F.substring(F.col(c), 2, 20).cast("bigint"))
    return kept.agg(F.count(F.lit(1)).alias("kept"), num("src").alias("src_sum"), num("dst").alias("dst_sum"))


@query(
    "J-13",
    f"""WITH e AS ({_E1_SQL}), k AS (SELECT concat('s', CAST(s AS STRING)) AS src, concat('p', CAST(p AS STRING)) AS dst FROM e ORDER BY first_order, src, dst LIMIT 200),
    ends AS (SELECT src AS id FROM k UNION SELECT dst FROM k), n AS (SELECT id, id IN (SELECT id FROM ends) AS core FROM ({_NODES_SQL}))
    SELECT id, core FROM (SELECT *, row_number() OVER (ORDER BY core DESC, id) AS r FROM n) WHERE core OR r <= 400""",
)
def edge_driven_nodes(t: Tables) -> DataFrame:
    nodes, _ = graph.edge_driven_nodes(_nodes(t).select("id"), _supply_edges(t), 200, 400, ["first_order", "src", "dst"])
    return nodes.select("id", "core")


@query(
    "T-03 G-08",
    f"""WITH e AS (SELECT concat('s', CAST(s AS STRING)) AS s, concat('p', CAST(p AS STRING)) AS p, w FROM ({_E1_SQL})), u AS (SELECT s AS node, p AS hop, w FROM e UNION ALL SELECT p, s, w FROM e), n AS (SELECT id, criticality, abs(load) / 10007 AS fused FROM ({_NODES_SQL})),
    r AS (SELECT node, hop, 5e-1 * w * criticality + 5e-1 * fused AS score, row_number() OVER (PARTITION BY node ORDER BY 5e-1 * w * criticality + 5e-1 * fused DESC, hop) AS rank FROM u JOIN n ON hop = id)
    SELECT node, rank, hop, round(score, 6) AS score FROM r WHERE rank <= 3""",
)
def next_hops(t: Tables) -> DataFrame:
    edges = _supply_edges(t).select("src", "dst", F.col("weight").alias("attention"))
    nodes = _nodes(t).select("id", "criticality", (F.abs("load") / 10007).alias("fused"))
    return graph.next_hops(edges, nodes, 3).select("node", "rank", "hop", F.round("score", 6).alias("score"))


@query(
    "P-25 T-05",
    f"""WITH n AS (SELECT id, type, abs(load) / 10007 AS score FROM ({_NODES_SQL})), c AS (SELECT concat('s', CAST(s_suppkey AS STRING)) AS id FROM supplier WHERE s_suppkey % 10 = 3),
    p AS (SELECT concat('p', CAST(p_partkey AS STRING)) AS id FROM part WHERE p_size = 7), x AS (SELECT id, type, CASE WHEN id IN (SELECT id FROM c) THEN 'compromised' WHEN id IN (SELECT id FROM p) THEN 'predicted' WHEN score > 0.6 THEN 'suspicious' ELSE 'clean' END AS status FROM n),
    y AS (SELECT *, CASE type WHEN 'ThreatGroup' THEN 'crown' ELSE 'server' END AS kind, CASE status WHEN 'compromised' THEN 'critical' WHEN 'predicted' THEN 'warning' ELSE status END AS severity FROM x)
    SELECT *, CASE severity WHEN 'critical' THEN 1 WHEN 'suspicious' THEN 2 WHEN 'warning' THEN 3 ELSE CASE WHEN type = 'ThreatGroup' THEN 4 ELSE 5 END END - CASE WHEN id IN (SELECT id FROM c) THEN 10 ELSE 0 END AS priority FROM y""",
)
def node_status(t: Tables) -> DataFrame:
    n = _nodes(t).select("id", "type", (F.abs("load") / 10007).alias("score"))
    c = t.supplier.where("s_suppkey % 10 = 3").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    p = t.part.where("p_size = 7").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    out = graph.node_status(n, c, p)
    prio = graph.display_priority(F.col("severity"), F.col("type"), F.col("status") == "compromised")
    return out.select("id", "type", "status", "kind", "severity", prio.alias("priority"))


# -- graph sources -------------------------------------------------------------
@query(
    "S-07 W-06 F-33",
    """WITH l AS (SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber, l_quantity, l_shipdate FROM lineitem)
    SELECT concat('s', CAST(l_suppkey AS STRING)) AS src, concat('p', CAST(l_partkey AS STRING)) AS dst, greatest(0e0, CAST(epoch(l_shipdate) - epoch(TIMESTAMP '1997-01-01') AS DOUBLE)) AS seconds FROM l""",
)
def temporal_edges(t: Tables) -> DataFrame:
    l = t.lineitem  # noqa: E741
    edge = F.struct(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("from"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("to"),
        F.array(F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamps"),
    )
    docs = l.select(F.to_json(F.struct(F.array(edge).alias("edges"))).alias("value"))
    doc = docs.select(F.from_json("value", graphs.GRAPH_SCHEMA).alias("g")).select("g.*")
    _, edges = graphs.graph_tables(doc)
    return graphs.temporal_edges(edges, F.lit("1997-01-01").cast("timestamp"))


def _lines(t: Tables, parts: list[str]) -> DataFrame:
    return t.lineitem.select(F.concat_ws(",", *[F.expr(p).cast("string") for p in parts]).alias("value"))


@query(
    "S-08 U-01",
    """WITH r AS (SELECT l_orderkey AS tm, concat('u', CAST(l_suppkey AS STRING)) AS u, concat('C', CAST(l_suppkey AS STRING)) AS s, concat('C', CAST(l_partkey AS STRING)) AS d FROM lineitem WHERE l_linenumber <> 7),
    e AS (SELECT u AS src, s AS dst, 'LOGGED_IN_FROM' AS relation, tm, CAST(NULL AS INT) AS label FROM r UNION ALL SELECT s, d, 'RED_TEAM_LATERAL', tm, 1 FROM r)
    SELECT relation, src, count(*) AS edges, CAST(sum(tm) AS BIGINT) AS time_sum, CAST(count(label) AS BIGINT) AS labelled FROM e GROUP BY relation, src""",
)
def lateral_movement_scan(t: Tables) -> DataFrame:
    lines = _lines(t, ["l_orderkey", "concat('u', l_suppkey)", "concat('C', l_suppkey)", "CASE WHEN l_linenumber <> 7 THEN concat('C', l_partkey) END"])
    _, edges = graphs.lateral_movement(lines)
    return edges.groupBy("relation", "src").agg(F.count(F.lit(1)).alias("edges"), F.sum("time_sec").alias("time_sum"), F.count("label").alias("labelled"))


@query(
    "S-12",
    "SELECT concat('C', CAST(l_suppkey AS STRING)) AS src, CASE l_linenumber % 2 WHEN 0 THEN '6' ELSE '17' END AS protocol, count(*) AS flows, CAST(sum(l_orderkey) AS BIGINT) AS time_sum FROM lineitem GROUP BY 1, 2",
)
def flow_text_scan(t: Tables) -> DataFrame:
    lines = _lines(t, ["l_orderkey", "1", "concat('C', l_suppkey)", "80", "concat('C', l_partkey)", "443", "CASE l_linenumber % 2 WHEN 0 THEN 6 ELSE 17 END", "3", "l_quantity"])
    _, edges = graphs.flow_text(lines)
    return edges.groupBy("src", "protocol").agg(F.count(F.lit(1)).alias("flows"), F.sum("time_sec").alias("time_sum"))


@query(
    "S-10 S-13 S-14",
    """SELECT concat('10.0.0.', CAST(l_suppkey % 200 AS STRING)) AS src, CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 0 ELSE 1 END AS label, count(*) AS flows, count(DISTINCT l_partkey) AS targets FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1, 2""",
)
def flow_table_scan(t: Tables) -> DataFrame:
    df = t.lineitem.select(
        F.concat(F.lit("10.0.0."), (F.col("l_suppkey") % 200).cast("string"), F.lit(" ")).alias(" Source IP"),
        F.when(F.col("l_linenumber") != 3, F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("destination ip"),
        F.expr("CASE l_returnflag WHEN 'N' THEN 'Normal' WHEN 'A' THEN ' BENIGN' ELSE 'DoS' END").alias("Label"), F.col("l_linenumber").alias("Protocol"),
    )
    _, edges = graphs.flow_table_edges(df, "APT_FLOW", "flows", params.BENIGN_WORDS)
    return edges.groupBy("src", "label").agg(F.count(F.lit(1)).alias("flows"), F.count_distinct("dst").alias("targets"))


@query(
    "S-11",
    """SELECT p_partkey AS row_id, 'sensor_p_size' AS src, 'sensor_p_retailprice' AS dst, p_retailprice AS value, CASE WHEN p_size > 40 THEN 1 ELSE 0 END AS label FROM part
    UNION ALL SELECT p_partkey, 'sensor_p_retailprice', 'sensor_half', p_retailprice / 2, CASE WHEN p_size > 40 THEN 1 ELSE 0 END FROM part WHERE p_partkey % 3 <> 0""",
)
def sensor_chain_scan(t: Tables) -> DataFrame:
    wide = t.part.select(
        "p_partkey", "p_size", "p_name", "p_retailprice", F.when(F.col("p_partkey") % 3 != 0, (F.col("p_retailprice") / 2).cast("string")).otherwise("n/a").alias("half")
    )
    _, edges = graphs.sensor_chain(wide, "p_partkey", ["p_size", "p_name", "p_retailprice", "half"], F.when(F.col("p_size") > 40, 1).otherwise(0))
    return edges.select("row_id", "src", "dst", "value", "label")


_STIX_SQL = """WITH o AS (SELECT p_partkey AS pos, CASE p_partkey % 8 WHEN 0 THEN 'attack-pattern' WHEN 1 THEN 'x-mitre-tactic' WHEN 2 THEN 'intrusion-set' WHEN 3 THEN 'malware' WHEN 4 THEN 'tool' WHEN 5 THEN 'campaign' WHEN 6 THEN 'course-of-action' ELSE 'identity' END AS type, concat('o', CAST(p_partkey AS STRING)) AS id, p_name FROM part),
 f AS (SELECT * FROM o WHERE pos % 8 < 3 ), n AS (SELECT * FROM f UNION ALL SELECT * FROM o WHERE pos % 8 BETWEEN 3 AND 6)"""


def _stix(t: Tables):
    kind = "CASE p_partkey % 8 WHEN 0 THEN 'attack-pattern' WHEN 1 THEN 'x-mitre-tactic' WHEN 2 THEN 'intrusion-set' WHEN 3 THEN 'malware' WHEN 4 THEN 'tool' WHEN 5 THEN 'campaign' WHEN 6 THEN 'course-of-action' ELSE 'identity' END"
    refs = F.array(
        F.struct(F.lit("other").alias("source_name"), F.lit("X").alias("external_id")),
        F.struct(F.lit("mitre-attack").alias("source_name"), F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("external_id")),
    )
    none = F.lit(None).cast("string")
    objects = t.part.select(
        F.col("p_partkey").alias("pos"), F.expr(kind).alias("type"), F.concat(F.lit("o"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), none.alias("description"),
        none.alias("source_ref"), none.alias("target_ref"), none.alias("relationship_type"), refs.alias("external_references"),
    )
    links = t.lineitem.select(
        F.lit(-1).cast("bigint").alias("pos"), F.lit("relationship").alias("type"), none.alias("id"), none.alias("name"), none.alias("description"),
        F.concat(F.lit("o"), F.col("l_partkey").cast("string")).alias("source_ref"), F.concat(F.lit("o"), F.col("l_suppkey").cast("string")).alias("target_ref"),
        F.when(F.col("l_linenumber") == 1, F.lit(None)).otherwise(F.lit("used-by")).alias("relationship_type"),
        F.lit(None).cast("array<struct<source_name:string,external_id:string>>").alias("external_references"),
    )
    return graphs.stix_tables(objects.unionByName(links), "pos")


@query("S-09 W-11 F-31", _STIX_SQL + " SELECT id, CASE pos % 8 WHEN 0 THEN 'Technique' WHEN 1 THEN 'Tactic' WHEN 2 THEN 'ThreatGroup' WHEN 3 THEN 'Software' WHEN 4 THEN 'Software' WHEN 5 THEN 'Campaign' ELSE 'Mitigation' END AS label, p_name AS name, CASE WHEN pos % 8 = 0 THEN concat('T', CAST(pos AS STRING)) ELSE '' END AS mitre_id FROM n")
def stix_nodes(t: Tables) -> DataFrame:
    nodes, _ = _stix(t)
    return nodes.select("id", "label", "name", "mitre_id")


@query("S-09 J-12", _STIX_SQL + " SELECT CASE WHEN l_linenumber = 1 THEN 'RELATES_TO' ELSE 'USED_BY' END AS relation, count(*) AS edges FROM lineitem WHERE concat('o', CAST(l_partkey AS STRING)) IN (SELECT id FROM n) AND concat('o', CAST(l_suppkey AS STRING)) IN (SELECT id FROM n) GROUP BY 1")
def stix_relations(t: Tables) -> DataFrame:
    _, edges = _stix(t)
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("edges"))


@query(
    "S-39",
    "SELECT l_suppkey AS src, l_partkey AS dst, l_returnflag AS relation, arg_max(l_quantity, (l_orderkey * 100 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT)) AS weight, max((l_orderkey * 100 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT)) AS seq FROM lineitem GROUP BY 1, 2, 3",
)
def merged_edges(t: Tables) -> DataFrame:
    e = t.lineitem.selectExpr("l_suppkey AS src", "l_partkey AS dst", "l_returnflag AS relation", "l_quantity AS weight", "(l_orderkey * 100 + l_linenumber) * 100 + CAST(l_quantity AS BIGINT) AS seq")
    return graph.merged_edges(e, "seq").select("src", "dst", "relation", "weight", "seq")


@query(
    "W-11",
    "SELECT flow_id FROM (SELECT l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS flow_id, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_partkey, l_linenumber, l_suppkey) AS r FROM lineitem) WHERE r <= 100",
)
def capped_rows(t: Tables) -> DataFrame:
    out = graphs.capped(t.lineitem, ["l_returnflag"], [F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey")], 100)
    return out.selectExpr("l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS flow_id")


# -- model jobs ----------------------------------------------------------------
@query("M-01 T-08")
def isolation_scores(t: Tables) -> DataFrame:
    """All 25 training features, scaled; forest of the published size."""
    f = cut_lineage(score_queries.training_features(t))
    values = [c for c in f.columns if c != "flow_id"]
    scale = {r["feature"]: (r["mean"], r["scale"]) for r in evaluate.scaler(f, values).collect()}
    f = f.select("flow_id", *[((F.col(v) - F.lit(scale[v][0])) / F.lit(scale[v][1])).alias(v) for v in values])
    model = models.fit_forest(f, "flow_id", values, trees=300, size=4096)
    return models.forest_scores(model["scored"], model).select("flow_id", F.round("isolation_score", 6).alias("isolation_score"))


@query("M-03 W-05")
def sequence_reconstruction(t: Tables) -> DataFrame:
    from vigilframe.operators import running

    e = d.events(t).withColumn("v", F.array(F.col("value") / 500, F.hour("ts") / F.lit(23.0), F.get_json_object("props", "$.k").cast("double") / 100))
    seqs = running.sliding_sequences(e, [F.col("micros"), F.col("event_id")], None, F.col("v"), 10)
    seqs = spread(cut_lineage(seqs.select("seq", F.flatten("sequence").alias("sequence"))), "seq")
    model = models.fit_sequences(seqs, 10, 3)
    return models.sequence_scores(model["scored"], model).select("seq", F.round("sequence_score", 4).alias("sequence_score"))
