"""Queries: file readers, summaries, cache upkeep and graph views over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.operators import audit, graph, report, route, running, tables
from vigilframe.plans import derived as d
from vigilframe.plans.graph_queries import _E1_SQL, _H_SQL, _NODES_SQL, _nodes, _supply_edges, _vectors
from vigilframe.plans.registry import Tables, query
from vigilframe.plans.report_queries import _incidents, _stats_sql
from vigilframe.session import cut_lineage, scratch_path
from vigilframe.sources import graphs, readers, writers


# Entries of an inventory file; a larger inventory has more files.
_PER_FILE = 1000


def _dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows with the file ``b`` they go to."""
    files = max(1, -(-rows.count() // _PER_FILE))
    return rows.withColumn("b", F.pmod(F.xxhash64(key), F.lit(files)))


def _object_file(t: Tables, rows: DataFrame, key: str, label: str) -> str:
    """Inventory files, each one JSON object keyed by id."""
    entry = F.concat(F.to_json(F.struct(F.col(key).alias("k"))).substr(F.lit(6), F.length(key) + 2), F.lit(":"), F.to_json(F.struct(*[c for c in rows.columns if c != key])))
    path = scratch_path(t.spark, label)
    body = F.concat(F.lit("{"), F.array_join(F.collect_list("e"), ","), F.lit("}")).alias("value")
    _dealt(rows.select(key, entry.alias("e")), key).groupBy("b").agg(body).write.partitionBy("b").text(path)
    return path


@query("S-06", f"SELECT asset_id, ip, criticality, safety_critical, sector FROM ({d.ASSET_SQL})")
def asset_inventory_file(t: Tables) -> DataFrame:
    rows = d.assets(t).select("asset_id", "ip", "type", "criticality", "mission", "sector", "internet_facing", "safety_critical", "can_reboot", "can_interrupt", "impact_if_compromised")
    return readers.read_assets(t.spark, _object_file(t, rows, "asset_id", "assets")).select("asset_id", "ip", "criticality", "safety_critical", "sector")


@query(
    "S-17",
    "SELECT concat('campaign-', CAST(n_nationkey AS STRING)) AS name, 2 AS steps, concat('T', CAST(1000 + n_regionkey AS STRING)) AS first_step, concat('watch ', n_name) AS prevention FROM nation",
)
def campaign_file(t: Tables) -> DataFrame:
    first = F.concat(F.lit("T"), (F.col("n_regionkey") + 1000).cast("string"))
    rows = t.nation.select(
        F.concat(F.lit("campaign-"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("description"), F.array(first, F.lit("T1486")).alias("ttp_sequence"),
        F.create_map(first, F.concat(F.lit("watch "), "n_name")).alias("preventive_actions"),
    )
    back = readers.read_campaigns(t.spark, _object_file(t, rows, "name", "campaigns"))
    step = F.get("ttp_sequence", 0)
    return back.select("name", F.size("ttp_sequence").alias("steps"), step.alias("first_step"), F.try_element_at("preventive_actions", step).alias("prevention"))


@query("S-18", "SELECT DISTINCT concat('asset-', CAST(s_suppkey AS STRING)) AS asset_id FROM supplier WHERE s_acctbal > 0")
def whitelist_file(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "whitelist")
    listed = t.supplier.where("s_acctbal > 0").select(F.concat(F.lit("asset-"), F.col("s_suppkey").cast("string")).alias("a"))
    body = F.to_json(F.struct(F.collect_list("a").alias("whitelisted_assets"))).alias("value")
    _dealt(listed.unionByName(listed), "a").groupBy("b").agg(body).write.partitionBy("b").text(path)
    return readers.id_list(t.spark.read.text(path, wholetext=True), "whitelisted_assets", "asset_id")


@query(
    "S-07",
    "SELECT concat('s', CAST(s_suppkey AS STRING)) AS src, concat('n', CAST(s_nationkey AS STRING)) AS dst, CASE WHEN s_suppkey % 2 = 0 THEN 'SSH' ELSE 'HTTPS' END AS protocol, "
    "CASE WHEN s_suppkey % 3 = 0 THEN 5e-1 ELSE 25e-2 END AS weight FROM supplier",
)
def asset_graph_file(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "graph")
    edge = F.struct(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("from"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("to"),
        F.when(F.col("s_suppkey") % 2 == 0, "ssh").otherwise("https").alias("protocol"), F.when(F.col("s_suppkey") % 3 != 0, 0.25).alias("weight"),
    )
    _dealt(t.supplier.select("s_suppkey", edge.alias("e")), "s_suppkey").groupBy("b").agg(F.collect_list("e").alias("edges")).write.partitionBy("b").json(path)
    _, edges = graphs.read_graph(t.spark, path)
    return edges.select("src", "dst", F.upper("protocol").alias("protocol"), "weight")


@query(
    "S-14 S-15",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE l_linenumber % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 47 END AS protocol, CASE WHEN l_returnflag = 'R' THEN 'attack' ELSE 'benign' END AS part FROM lineitem)
    SELECT part, protocol, count(*) AS flows, round(sum(l_quantity * 3), 2) AS bytes FROM r GROUP BY part, protocol""",
)
def training_set_files(t: Tables) -> DataFrame:
    """Data and label rows written as two tables of the same order, zipped back by position and split by label."""
    rows = cut_lineage(t.lineitem.select(
        F.when(F.col("l_linenumber") % 3 == 0, "TCP").when(F.col("l_linenumber") % 3 == 1, "udp").otherwise("47").alias("proto"), F.col("l_quantity").alias("sbytes"),
        (F.col("l_quantity") * 2).alias("dbytes"), F.when(F.col("l_returnflag") == "R", "DoS").otherwise(" benign ").alias("label"),
    ))
    paths = [scratch_path(t.spark, "training") for _ in range(2)]
    rows.select("proto", "sbytes", "dbytes").write.parquet(paths[0])
    rows.select("label").write.parquet(paths[1])
    flows = graphs.training_flows(t.spark.read.parquet(paths[0]), t.spark.read.parquet(paths[1]))
    benign, attack = graphs.benign_split(flows, "label")
    both = benign.withColumn("part", F.lit("benign")).unionByName(attack.withColumn("part", F.lit("attack")))
    return both.groupBy("part", "protocol").agg(F.count("*").alias("flows"), F.round(F.sum("bytes"), 2).alias("bytes"))


@query(
    "A-02",
    _stats_sql()
    + " SELECT (SELECT max(incidents) FROM s WHERE dimension = 'total') AS total, (SELECT item FROM s WHERE dimension = 'type' ORDER BY incidents DESC, item DESC LIMIT 1) AS top_type, "
    "(SELECT string_agg(item, ',' ORDER BY incidents DESC, item) FROM (SELECT * FROM s WHERE dimension = 'actor' ORDER BY incidents DESC, item LIMIT 5)) AS top_actors",
)
def quick_summary(t: Tables) -> DataFrame:
    return report.quick_summary(report.statistics(_incidents(t))).select("total", "top_type", F.array_join("top_actors", ",").alias("top_actors"))


@query("S-37 T-06", _stats_sql() + " SELECT dimension, item, incidents FROM s")
def report_files(t: Tables) -> DataFrame:
    """The JSON, Markdown and HTML report; the statistics are read back, and every item must be in both texts."""
    path = scratch_path(t.spark, "report")
    writers.write_report(report.statistics(_incidents(t)), path, "Incidents", "all")
    back = t.spark.read.schema("dimension string, item string, incidents bigint").json(f"{path}/statistics")
    texts = [t.spark.read.text(f"{path}/{n}", wholetext=True).agg(F.array_join(F.collect_list("value"), "").alias(n)) for n in ("markdown", "html")]
    # two one-row tables
    named = back.crossJoin(texts[0]).crossJoin(texts[1])
    told = F.col("dimension").isin("total", "technique") | (F.col("markdown").contains(F.concat(F.lit("| "), "item", F.lit(" |"))) & F.col("html").contains(F.concat(F.lit("<td>"), "item", F.lit("</td>"))))
    return named.where(told).select("dimension", "item", "incidents")


@query(
    "A-24",
    f"""WITH r AS (SELECT concat('asset-', CAST(user_id AS STRING)) AS asset_id, CASE WHEN value > 95 THEN 'quarantined' WHEN value > 60 THEN 'flagged' ELSE 'clean' END AS outcome FROM events),
    h AS (SELECT DISTINCT asset_id FROM r WHERE outcome <> 'clean')
    SELECT count(*) FILTER (outcome = 'quarantined') AS quarantined, count(*) FILTER (outcome = 'flagged') AS flagged, count(*) FILTER (outcome = 'clean') AS clean,
    (SELECT count(*) FROM h) AS assets_hit, (SELECT count(*) FROM h JOIN ({d.ASSET_SQL}) a USING (asset_id) WHERE criticality = 'CRITICAL') AS crown_jewels_hit FROM r""",
)
def dashboard_counters(t: Tables) -> DataFrame:
    outcome = F.when(F.col("value") > 95, "quarantined").when(F.col("value") > 60, "flagged").otherwise("clean")
    return report.dashboard(d.events(t).select("asset_id", outcome.alias("outcome")), d.assets(t))


@query(
    "A-18",
    "SELECT count(*) AS audit_log_entries, true AS chain_valid, (SELECT count(*) FROM customer) AS cognitive_memory_count, (SELECT count(*) FROM part WHERE p_size > 25) AS shadow_promotions, "
    "(SELECT count(*) FROM part WHERE p_size <= 25) AS shadow_rejections FROM events",
)
def audit_log_statistics(t: Tables) -> DataFrame:
    log = audit.chained(d.events(t), "user_id", [F.col("micros"), F.col("event_id")], running.time_bucket(F.col("micros"), 86_400), ["event_id"])
    return audit.audit_statistics(cut_lineage(log), d.hypotheses(t), t.part.select((F.col("p_size") > 25).alias("promoted")), "user_id")


@query(
    "J-09",
    f"SELECT decision_id, 'audit_log' AS source, risk_score > 0.6 OR (action_taken IS NOT NULL AND action_taken NOT IN ('MONITOR', 'none')) AS flagged FROM ({d.DECISION_SQL})",
)
def runs_from_audit_log(t: Tables) -> DataFrame:
    log = d.decisions(t).select(
        F.concat(F.lit("A-"), F.col("decision_id").cast("string")).alias("audit_id"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("asset_id"),
        "risk_score", "action_taken", "decision_id", F.col("created_at").alias("stored_at"),
    )
    return tables.runs_from_log(log).select("decision_id", "source", "flagged")


@query("T-01", f"SELECT decision_id, action_taken FROM ({d.DECISION_SQL}) ORDER BY created_at DESC, decision_id DESC LIMIT 100")
def audit_excerpts(t: Tables) -> DataFrame:
    return audit.excerpts(d.decisions(t), ["decision_id", "action_taken"], F.struct("created_at", "decision_id"), 100)


@query(
    "S-34",
    """WITH c AS (SELECT o_custkey AS k, max(o_orderdate) AS seen FROM orders GROUP BY o_custkey), l AS (SELECT k FROM c WHERE seen + INTERVAL 30 DAY > TIMESTAMP '2001-03-01' AND k % 7 <> 0)
    SELECT c_custkey AS k, c_custkey IN (SELECT k FROM l) AS held, (SELECT count(*) FROM l) AS entries FROM customer""",
)
def cache_upkeep(t: Tables) -> DataFrame:
    """Deleting every seventh key, then which keys are held and how many entries live."""
    rows = t.orders.select(F.col("o_custkey").cast("string").alias("fingerprint"), F.col("o_orderkey").alias("decision_id"), F.col("o_orderdate").alias("cached_at"))
    cache = route.cached(rows)
    cache = tables.without_keys(cache, t.customer.where("c_custkey % 7 = 0").select(F.col("c_custkey").cast("string").alias("fingerprint")), "fingerprint")
    now = F.lit("2001-03-01").cast("timestamp_ntz")
    held = route.cache_summary(cache, now, t.customer.select(F.col("c_custkey").cast("string").alias("fingerprint")))
    size = route.cache_size(cache, now)  # one row
    return held.crossJoin(size).select(F.col("fingerprint").cast("bigint").alias("k"), F.col("exists").alias("held"), "entries")


@query(
    "G-05",
    f"""WITH e AS (SELECT concat('s', CAST(s AS STRING)) AS src, concat('p', CAST(p AS STRING)) AS dst FROM ({_E1_SQL})), h AS ({_H_SQL}),
    m AS (SELECT src AS id, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM e JOIN h ON dst = id GROUP BY src),
    x AS (SELECT h.id, h.a, h.b, h.c, coalesce(m.a, h.a) AS ma, coalesce(m.b, h.b) AS mb, coalesce(m.c, h.c) AS mc FROM h LEFT JOIN m USING (id)),
    l AS (SELECT id, a * 5e-1 - b * 25e-2 + c + ma * 5e-1 + mb * 1e-1 - mc AS y1, b * 5e-1 - a + ma - mb * 5e-1 + mc * 2e-1 AS y2 FROM x)
    SELECT id, round(greatest(y1 / sqrt(y1 * y1 + y2 * y2), 0e0), 5) AS o1, round(greatest(y2 / sqrt(y1 * y1 + y2 * y2), 0e0), 5) AS o2 FROM l""",
)
def neighbour_layer(t: Tables) -> DataFrame:
    out = graph.neighbour_layer(_vectors(t), _supply_edges(t).select("src", "dst"), 3, [[0.5, -0.25, 1.0, 0.5, 0.1, -1.0], [-1.0, 0.5, 0.0, 1.0, -0.5, 0.2]])
    return out.select("id", *[F.round(F.get("out", i), 5).alias(f"o{i + 1}") for i in range(2)])


@query(
    "T-05",
    f"""WITH n AS (SELECT id, CASE WHEN load > 9500 THEN 1 WHEN load > 1500 THEN 3 WHEN type = 'ThreatGroup' THEN 4 ELSE 5 END AS priority FROM ({_NODES_SQL})),
    r AS (SELECT *, row_number() OVER (ORDER BY priority, id) AS rk FROM n)
    SELECT id, priority, CASE WHEN rk <= 15 THEN CAST(rk AS INT) END AS place, rk <= 15 AS core FROM r""",
)
def display_groups(t: Tables) -> DataFrame:
    severity = F.when(F.col("load") > 9500, "critical").when(F.col("load") > 1500, "warning").otherwise("")
    nodes = _nodes(t).select("id", graph.display_priority(severity, F.col("type"), F.lit(False)).alias("priority"))
    return graph.display_groups(nodes).select("id", "priority", "place", "core")
