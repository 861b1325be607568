"""Telemetry views of the driver tables, as matching Spark frames and SQL texts.

The driver tables stand in for telemetry: suppliers are assets, events are raw
events, line items are network flows, orders are decisions and customers are
hypotheses. Expressions use the SQL subset both engines share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.plans.registry import Tables, project, select_sql
from vigilframe.session import spread

# -- assets -------------------------------------------------------------------
ASSET = {
    "asset_id": "concat('asset-', CAST(s_suppkey AS STRING))",
    "ip": "concat('10.', CAST(s_nationkey AS STRING), '.', CAST(s_suppkey % 250 AS STRING), '.7')",
    "criticality": "CASE s_suppkey % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END",
    "mission": "CASE s_nationkey % 5 WHEN 0 THEN 'exam_portal_west' WHEN 1 THEN 'power_management' "
    "WHEN 2 THEN 'patient_records' WHEN 3 THEN 'ticketing' ELSE 'unknown' END",
    "type": "CASE s_suppkey % 3 WHEN 0 THEN 'web_server' WHEN 1 THEN 'database' ELSE 'plc' END",
    "safety_critical": "s_suppkey % 7 = 0",
    "can_reboot": "s_suppkey % 5 <> 0",
    "can_interrupt": "s_suppkey % 3 <> 0",
    "impact_if_compromised": "CASE s_suppkey % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' ELSE 'HIGH' END",
    "internet_facing": "s_suppkey % 2 = 0",
    "sector": "r_name",
    "s_suppkey": "s_suppkey",
}
_ASSET_FROM = (
    "supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)
ASSET_SQL = select_sql(_ASSET_FROM, ASSET)


def assets(t: Tables) -> DataFrame:
    joined = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return project(joined, ASSET)


# -- raw events ---------------------------------------------------------------
EVENT = {
    "event_id": "event_id",
    "user_id": "user_id",
    "asset_id": "concat('asset-', CAST(user_id AS STRING))",
    "event_type": "event_type",
    "value": "value",
    "props": "props",
    "ts": "ts",
    "source": "CASE user_id % 10 WHEN 0 THEN 'CERT-In Advisory' WHEN 1 THEN 'vendor-crowdstrike' WHEN 2 THEN 'Internal' "
    "WHEN 3 THEN 'partner feed' WHEN 4 THEN 'q' WHEN 5 THEN 'untrusted feed' WHEN 6 THEN 'N V D' WHEN 7 THEN 'demo_env' "
    "WHEN 8 THEN 'MITRE' ELSE 'xyzzy' END",
}
EVENT_SQL = select_sql("events", {**EVENT, "micros": "epoch_us(ts)"})


def events(t: Tables) -> DataFrame:
    return project(t.events, {**EVENT, "micros": "unix_micros(CAST(ts AS TIMESTAMP))"})


# -- network flows ------------------------------------------------------------
FLOW = {
    "flow_id": "l_orderkey * 10000000 + l_partkey * 10 + l_linenumber",
    "src": "l_suppkey",
    "dst": "l_partkey",
    "bytes": "l_extendedprice * 7.0710678e0",
    "src_port": "1024 + (l_partkey * 37) % 64000",
    "dst_port": "CASE l_suppkey % 8 WHEN 0 THEN 22 WHEN 1 THEN 53 WHEN 2 THEN 80 WHEN 3 THEN 443 WHEN 4 THEN 3389 "
    "WHEN 5 THEN 4444 WHEN 6 THEN 389 ELSE 51000 END",
    "flow_duration": "l_quantity * 20000 * l_linenumber",
    "fwd_packets": "l_quantity",
    "bwd_packets": "l_linenumber * 2",
    "protocol": "CASE l_linenumber % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN '17' ELSE 'icmp' END",
    "proto_number": "CASE l_linenumber % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END",
    "status": "CASE l_linestatus WHEN 'O' THEN 200 ELSE 403 END",
    "label": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    "l_shipdate": "l_shipdate",
    "hours": "CAST(l_orderkey % 24 AS INT)",
}
FLOW_SQL = select_sql("lineitem", {**FLOW, "seen_at": "l_shipdate + to_hours(CAST(l_orderkey % 24 AS INT))"})


def flows(t: Tables) -> DataFrame:
    return project(spread(t.lineitem, "l_orderkey"), {**FLOW, "seen_at": "l_shipdate + make_dt_interval(0, CAST(l_orderkey % 24 AS INT), 0, 0)"})


# -- decisions ----------------------------------------------------------------
DECISION = {
    "decision_id": "o_orderkey",
    "hypothesis_id": "o_custkey",
    "action_taken": "CASE o_orderpriority WHEN '1-URGENT' THEN 'ISOLATE_HOST' WHEN '2-HIGH' THEN 'BLOCK_IP' "
    "WHEN '3-MEDIUM' THEN 'REVOKE_SESSION' WHEN '4-NOT SPECIFIED' THEN 'MONITOR' ELSE 'none' END",
    "risk_score": "o_totalprice / 600000",
    "blast_radius": "(o_orderkey % 101) / 100e0",
    "status": "CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'applied' ELSE 'rejected' END",
    "human_reviewed": "o_orderstatus = 'F' OR o_orderkey % 9 = 0",
    "created_at": "o_orderdate",
}
DECISION_SQL = select_sql("orders", DECISION)


def decisions(t: Tables) -> DataFrame:
    return project(t.orders, DECISION)


# -- hypotheses ---------------------------------------------------------------
CHAIN = (
    "CASE c_custkey % 8 WHEN 0 THEN 'T1595,T1190,T1059,T1003' WHEN 1 THEN 'T1566,T1078' WHEN 2 THEN 'T1486' "
    "WHEN 3 THEN 'T1499,T1021' WHEN 4 THEN 'T1190,T1204' WHEN 5 THEN 'T1595' WHEN 6 THEN 'T9999' ELSE '' END"
)
HYPOTHESIS = {
    "hypothesis_id": "c_custkey",
    "goal": "concat('Investigate ASSET-', CAST(c_custkey % 40 AS STRING), ' for ', lower(c_mktsegment))",
    "confidence": "(c_acctbal + 1000) / 11000",
    "uncertainty": "(c_custkey % 17) / 20e0",
    "state": "CASE c_custkey % 4 WHEN 0 THEN 'ACTIVE_INVESTIGATION' WHEN 1 THEN 'CONFIRMED' WHEN 2 THEN 'REJECTED' ELSE 'CONTAINED' END",
    "chain_text": CHAIN,
    "mission_impact": "c_mktsegment",
    "actor": "CASE c_nationkey % 4 WHEN 0 THEN 'APT41' WHEN 1 THEN 'SideWinder' WHEN 2 THEN 'Lazarus' END",
    "asset_id": "concat('asset-', CAST(c_custkey % 120 AS STRING))",
    "supporting": "c_custkey % 5",
    "c_nationkey": "c_nationkey",
}
HYPOTHESIS_SQL = select_sql("customer", HYPOTHESIS)


def hypotheses(t: Tables) -> DataFrame:
    chain = F.filter(F.split("chain_text", ","), lambda x: x != "")
    return project(t.customer, HYPOTHESIS).withColumn("chain", chain)


CHAIN_LIST_SQL = "list_filter(string_split(chain_text, ','), lambda x: x <> '')"


# -- log texts ----------------------------------------------------------------
TEXTS_SQL = (
    "SELECT concat('d', CAST(doc_id AS STRING)) AS text_id, text FROM documents UNION ALL "
    "SELECT concat('p', CAST(page_id AS STRING)), html FROM pages UNION ALL "
    "SELECT concat('c', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)), text FROM conversations"
)


def texts(t: Tables) -> DataFrame:
    d = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("text_id"), "text")
    p = t.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("text_id"), F.col("html").alias("text"))
    c = t.conversations.select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("text_id"), "text"
    )
    return spread(d, "text_id").unionByName(spread(p, "text_id")).unionByName(spread(c, "text_id"))


def trust_sql(label: str, relation: str, keep: str) -> str:
    """SQL for the trust score of a label column: table join, exact hit or best rank."""
    from vigilframe.params import TRUST_TABLE

    values = ", ".join(f"('{k}', CAST({v} AS DOUBLE), {i})" for i, (k, v) in enumerate(TRUST_TABLE))
    return (
        f"WITH rel AS ({relation}), tt(k, score, rnk) AS (VALUES {values}), "
        f"lab AS (SELECT DISTINCT {label} AS lab, lower(regexp_replace({label}, '[\\s\\-_]', '', 'g')) AS nk FROM rel), "
        "hits AS (SELECT lab, nk, arg_min(score, CASE WHEN nk = k THEN -1 ELSE rnk END) AS score FROM lab JOIN tt "
        "ON nk <> '' AND (contains(nk, k) OR contains(k, nk)) GROUP BY lab, nk), "
        f"scored AS (SELECT rel.*, coalesce(hits.score, CAST(0 AS DOUBLE)) AS trust_score FROM rel LEFT JOIN hits ON rel.{label} = hits.lab) {keep}"
    )
