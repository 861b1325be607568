"""Queries: enrichment, membership, matching, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe import params
from vigilframe.functions import records, scoring, text
from vigilframe.operators import attribution, enrich, federation, policy, route, similarity, tables
from vigilframe.plans import derived as d
from vigilframe.plans.registry import Tables, query

_ENRICHED_SQL = f"""
WITH a AS ({d.ASSET_SQL}), e AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (concat('10.', CAST(user_id % 25 AS STRING), '.', CAST(user_id AS STRING), '.7')) ELSE asset_id END AS asset_key
  FROM ({d.EVENT_SQL})),
ip AS (SELECT ip, arg_min(criticality, asset_id) AS criticality, arg_min(mission, asset_id) AS mission, arg_min(type, asset_id) AS type,
  arg_min(safety_critical, asset_id) AS safety_critical, arg_min(can_reboot, asset_id) AS can_reboot, arg_min(can_interrupt, asset_id) AS can_interrupt,
  arg_min(impact_if_compromised, asset_id) AS impact_if_compromised FROM a GROUP BY ip)
SELECT e.event_id, coalesce(a.criticality, ip.criticality, 'MEDIUM') AS criticality, coalesce(a.mission, ip.mission, 'unknown') AS mission,
  coalesce(a.type, ip.type, 'unknown') AS device_type, coalesce(a.safety_critical, ip.safety_critical, false) AS safety_critical,
  coalesce(a.can_reboot, ip.can_reboot, true) AS can_reboot, coalesce(a.can_interrupt, ip.can_interrupt, true) AS can_interrupt,
  coalesce(a.impact_if_compromised, ip.impact_if_compromised, 'MEDIUM') AS impact_if_compromised,
  (a.asset_id IS NOT NULL OR ip.ip IS NOT NULL) AS asset_known
FROM e LEFT JOIN a ON e.asset_key = a.asset_id LEFT JOIN ip ON e.asset_key = ip.ip
"""


def _enriched(t: Tables) -> DataFrame:
    key = "CASE WHEN event_id % 3 = 0 THEN concat('10.', CAST(user_id % 25 AS STRING), '.', CAST(user_id AS STRING), '.7') ELSE asset_id END"
    e = d.events(t).withColumn("asset_key", F.expr(key))
    return enrich.with_asset(e, d.assets(t), "asset_key")


@query("J-01 P-10 S-06", _ENRICHED_SQL)
def asset_enrichment(t: Tables) -> DataFrame:
    e = _enriched(t)
    context = records.control_context(F.lit(""), F.struct(*enrich.ASSET_COLUMNS))
    return e.withColumn("c", context).select(
        "event_id", "criticality", "mission", "c.device_type", "c.safety_critical", "c.can_reboot", "c.can_interrupt",
        "c.impact_if_compromised", "asset_known",
    )


@query(
    "J-02",
    f"""WITH a AS (SELECT ip, min(asset_id) AS owner FROM ({d.ASSET_SQL}) GROUP BY ip),
    f AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN concat('10.', CAST(user_id % 25 AS STRING), '.', CAST(user_id AS STRING), '.7') END AS dst_ip,
      CASE WHEN event_id % 4 = 1 THEN '10.15.0.7' ELSE '192.0.2.1' END AS src_ip,
      CASE WHEN event_id % 4 = 3 THEN 'given-1' END AS given FROM events)
    SELECT event_id, coalesce(owner, given, 'UNKNOWN') AS asset_id FROM f LEFT JOIN a ON coalesce(dst_ip, src_ip) = ip""",
)
def asset_resolution(t: Tables) -> DataFrame:
    f = t.events.selectExpr(
        "event_id",
        "CASE WHEN event_id % 4 = 0 THEN concat('10.', CAST(user_id % 25 AS STRING), '.', CAST(user_id AS STRING), '.7') END AS dst_ip",
        "CASE WHEN event_id % 4 = 1 THEN '10.15.0.7' ELSE '192.0.2.1' END AS src_ip",
        "CASE WHEN event_id % 4 = 3 THEN 'given-1' END AS given",
    )
    return enrich.resolved_asset(f, d.assets(t), F.col("dst_ip"), F.col("src_ip"), F.col("given")).select("event_id", "asset_id")


@query(
    "J-03 S-34",
    """WITH cache AS (SELECT sha256(concat('k', CAST(o_custkey AS STRING))) AS fp, o_orderkey, o_totalprice, o_orderdate FROM orders),
    live AS (SELECT fp, arg_max(o_orderkey, o_orderdate + to_microseconds(o_orderkey)) AS decision_id FROM cache WHERE o_orderdate + INTERVAL 30 DAY > TIMESTAMP '2001-03-01' GROUP BY fp)
    SELECT c_custkey, decision_id FROM customer LEFT JOIN live ON sha256(concat('k', CAST(c_custkey AS STRING))) = fp""",
)
def exact_cache_hits(t: Tables) -> DataFrame:
    key = lambda c: F.sha2(F.concat(F.lit("k"), F.col(c).cast("string")), 256)
    cache = route.cached(
        t.orders.select(
            key("o_custkey").alias("fingerprint"), F.col("o_orderkey").alias("decision_id"), F.col("o_totalprice").alias("risk_score"),
            (F.col("o_orderdate") + F.expr("make_dt_interval(0, 0, 0, o_orderkey / 1000000.0)")).alias("cached_at"),
            F.col("o_orderdate").alias("day"),
        )
    ).withColumn("expires_at", F.col("day") + F.make_dt_interval(F.lit(30)))
    events = t.customer.select("c_custkey", key("c_custkey").alias("content_fingerprint"))
    hits = route.exact_hits(events, cache, F.lit("2001-03-01").cast("timestamp_ntz"))
    return hits.select("c_custkey", F.col("hit.decision_id").alias("decision_id"))


_VEC_SQL = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings"
_NN_SQL = (
    f"WITH v AS ({_VEC_SQL}), p AS (SELECT a.vec_id AS query_id, b.vec_id AS vector_id, a.label AS qlabel, b.label AS vlabel, "
    "list_cosine_similarity(a.e, b.e) AS similarity FROM v a, v b WHERE {cond}), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, vector_id) AS rank FROM p) "
)


@query(
    "J-06 S-35",
    _NN_SQL.format(cond="a.vec_id <> b.vec_id")
    + "SELECT query_id, vector_id, rank, round(similarity, 5) AS similarity, similarity >= 0.85 AS above_threshold FROM r WHERE rank <= 3",
)
def nearest_vectors(t: Tables) -> DataFrame:
    v = similarity.checked_vectors(t.embeddings, "embedding", 64)
    best = similarity.top_matches(
        v, v, 3, query_id="vec_id", vector_id="vec_id", query_vector="embedding", vector="embedding", exclude_same=True
    )
    return best.select(
        "query_id", "vector_id", "rank", F.round("similarity", 5).alias("similarity"),
        (F.col("similarity") >= params.FUZZY_THRESHOLD).alias("above_threshold"),
    )


@query(
    "J-03 J-04 J-05 A-04",
    _NN_SQL.format(cond="a.vec_id % 2 = 1 AND b.vec_id % 2 = 0 AND (a.vec_id % 6 <> 1 OR (a.vec_id - 1) % 8 = 0)")
    + ", n AS (SELECT * FROM r WHERE rank = 1), j AS (SELECT query_id, similarity, CASE WHEN similarity < 0.2 THEN 'below_threshold' "
    "WHEN qlabel % 2 <> vlabel % 2 THEN 'criticality_mismatch' WHEN vector_id % 8 = 0 THEN 'no_cached_decision' ELSE 'fuzzy' END AS reason, vector_id FROM n), "
    "routed AS (SELECT vec_id AS evidence_id, 1 AS path, 1e0 AS similarity, CAST((vec_id - 1) * 10 AS BIGINT) AS decision_id, "
    "((vec_id - 1) % 97) / 100e0 AS risk_score, 'exact' AS reason FROM embeddings WHERE vec_id % 2 = 1 AND vec_id % 6 = 1 AND (vec_id - 1) % 8 <> 0 "
    "UNION ALL SELECT query_id, CASE WHEN reason = 'fuzzy' THEN 2 ELSE 3 END, greatest(similarity, 0e0), "
    "CASE WHEN reason = 'fuzzy' THEN vector_id * 10 END, CASE WHEN reason = 'fuzzy' THEN (vector_id % 97) / 100e0 * 95e-2 END, reason FROM j) "
    "SELECT evidence_id, path, round(similarity, 5) AS similarity, decision_id, round(risk_score, 4) AS risk_score, reason FROM routed",
)
def three_way_routing(t: Tables) -> DataFrame:
    e = t.embeddings.where("vec_id % 2 = 1")
    fp = lambda c: F.concat(F.lit("fp-"), c.cast("string"))
    crit = F.when(F.col("label") % 2 == 0, "HIGH").otherwise("LOW")
    base = F.when(F.col("vec_id") % 6 == 1, F.col("vec_id") - 1).otherwise(-F.col("vec_id"))
    events = e.select(F.col("vec_id").alias("evidence_id"), fp(base).alias("content_fingerprint"), crit.alias("criticality"), "embedding")
    known = t.embeddings.where("vec_id % 2 = 0")
    vectors = known.select(F.col("vec_id").alias("vector_id"), fp(F.col("vec_id")).alias("fingerprint"), crit.alias("criticality"), "embedding")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    cache = route.cached(
        known.where("vec_id % 8 <> 0").select(
            fp(F.col("vec_id")).alias("fingerprint"), (F.col("vec_id") * 10).alias("decision_id"),
            ((F.col("vec_id") % 97) / F.lit(100.0)).alias("risk_score"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("cached_at"),
        )
    )
    routed = route.route(events, cache, vectors, now, threshold=0.2)
    return routed.select(
        "evidence_id", "path", F.round("similarity", 5).alias("similarity"), "decision_id", F.round("risk_score", 4).alias("risk_score"), "reason"
    )


@query(
    "A-04",
    """WITH r AS (SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 1 WHEN user_id % 5 < 3 THEN 2 ELSE 3 END AS path, value / 7 AS ms FROM events)
    SELECT count(*) AS total, """
    + ", ".join(
        f"CAST(sum(CAST(path = {p} AS INT)) AS BIGINT) AS path_{p}_count, round(sum(CAST(path = {p} AS INT)) * 100e0 / count(*), 1) AS path_{p}_pct, "
        f"round(avg(CASE WHEN path = {p} THEN ms END), 3) AS path_{p}_avg_ms"
        for p in (1, 2, 3)
    )
    + ", round(avg(ms), 3) AS avg_timing_ms, round(sum(CAST(path < 3 AS INT)) * 100e0 / count(*), 1) AS cache_hit_rate_pct FROM r",
)
def routing_statistics(t: Tables) -> DataFrame:
    r = t.events.selectExpr("CASE WHEN user_id % 5 = 0 THEN 1 WHEN user_id % 5 < 3 THEN 2 ELSE 3 END AS path", "value / 7 AS timing_ms")
    return route.routing_stats(r)


@query(
    "J-07 S-18 F-22",
    f"""WITH h AS ({d.HYPOTHESIS_SQL}), x AS (SELECT hypothesis_id, confidence + hypothesis_id / 3e7 AS confidence,
      hypothesis_id % 40 IN (SELECT s_suppkey % 40 FROM supplier WHERE s_suppkey % 6 = 0) AS whitelisted,
      c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AS scanner, hypothesis_id % 11 = 0 AS valid_cert FROM h),
    c1 AS (SELECT *, CASE WHEN whitelisted THEN round(confidence * 8e-1, 6) ELSE confidence END AS k1 FROM x),
    c2 AS (SELECT *, CASE WHEN scanner THEN round(k1 * 85e-2, 6) ELSE k1 END AS k2 FROM c1),
    c3 AS (SELECT *, CASE WHEN valid_cert THEN round(k2 * 9e-1, 6) ELSE k2 END AS k3 FROM c2)
    SELECT hypothesis_id, whitelisted, scanner, valid_cert, round(k3, 4) AS confidence FROM c3""",
)
def counter_evidence(t: Tables) -> DataFrame:
    h = d.hypotheses(t)
    white = t.supplier.where("s_suppkey % 6 = 0").select((F.col("s_suppkey") % 40).alias("id"))
    scanners = t.nation.where("n_regionkey = 2").select(F.col("n_nationkey").alias("id"))
    h = enrich.marked_membership(h, F.col("hypothesis_id") % 40, white, "id", "whitelisted")
    h = enrich.marked_membership(h, F.col("c_nationkey"), scanners, "id", "scanner").withColumn("valid_cert", F.col("hypothesis_id") % 11 == 0)
    checks = {n: F.col(n) for n in ("whitelisted", "scanner", "valid_cert")}
    return h.select(
        "hypothesis_id", *checks, F.round(scoring.counter_evidence(F.col("confidence") + F.col("hypothesis_id") / F.lit(3e7), checks, digits=6), 4).alias("confidence")
    )


# -- indicators ---------------------------------------------------------------
_IOC_RX = {
    "hash": (r"\b([a-fA-F0-9]{64}|[a-fA-F0-9]{40}|[a-fA-F0-9]{32})\b", 1),
    "ip": (r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b", 2),
    "domain": (r"\b([a-zA-Z0-9-]{2,63}\.[a-zA-Z]{2,6})\b", 3),
    "url": (r"""(https?://[^\s"''<>]+)""", 4),
}
_PRIV = r"^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|127\.|0\.0\.0\.0)"
_PRIV_SHARE = _PRIV.replace(r"127\.|", r"127\.|169\.254\.|")
_IOC_TEXT_SQL = f"SELECT text_id, concat(text, ' c2 at 203.0.113.', CAST(length(text) % 200 AS STRING), ' and 10.1.2.3 via https://evil', CAST(length(text) % 9 AS STRING), '.example.com/x sha ', substring(sha256(text), 1, CASE length(text) % 3 WHEN 0 THEN 32 WHEN 1 THEN 40 ELSE 64 END)) AS text FROM ({d.TEXTS_SQL})"


def _ioc_texts(t: Tables) -> DataFrame:
    n = F.length("text")
    digest = F.sha2("text", 256)
    cut = F.when(n % 3 == 0, F.substring(digest, 1, 32)).when(n % 3 == 1, F.substring(digest, 1, 40)).otherwise(digest)
    return d.texts(t).withColumn(
        "text",
        F.concat("text", F.lit(" c2 at 203.0.113."), (n % 200).cast("string"), F.lit(" and 10.1.2.3 via https://evil"), (n % 9).cast("string"), F.lit(".example.com/x sha "), cut),
    )


@query(
    "F-03 T-04 U-02",
    f"WITH s AS ({_IOC_TEXT_SQL}), x AS ("
    + " UNION ALL ".join(f"SELECT text_id, '{k}' AS type, {pr} AS priority, unnest(regexp_extract_all(text, '{rx}', 1)) AS value FROM s" for k, (rx, pr) in _IOC_RX.items())
    + f"), k AS (SELECT * FROM x WHERE NOT (type = 'ip' AND regexp_matches(value, '{_PRIV}')) AND NOT (type = 'domain' AND length(value) < 5)) "
    "SELECT text_id, value, arg_min(type, priority) AS type, CAST(min(priority) AS INT) AS priority FROM k GROUP BY text_id, value",
)
def extracted_iocs(t: Tables) -> DataFrame:
    return _ioc_texts(t).select("text_id", F.explode(text.iocs(F.col("text"))).alias("i")).select("text_id", "i.value", "i.type", "i.priority")


@query(
    "F-04 F-10 F-11 P-28 P-29 P-31",
    f"WITH s AS ({_IOC_TEXT_SQL}), c AS (SELECT *, (length(text) % 41) / 40e0 AS confidence FROM s), ok AS (SELECT * FROM c WHERE confidence > 0.85), "
    f"""v AS (SELECT text_id, confidence, 'ip' AS kind, unnest(list_filter(regexp_extract_all(text, '{_IOC_RX['ip'][0]}', 1), lambda x: NOT regexp_matches(x, '{_PRIV_SHARE}'))) AS value FROM ok
    UNION ALL SELECT text_id, confidence, 'hash', unnest(list_distinct(regexp_extract_all(text, '{_IOC_RX['hash'][0]}', 1))) FROM ok
    UNION ALL SELECT text_id, confidence, 'domain', unnest(list_distinct(list_filter(regexp_extract_all(text, '{_IOC_RX['domain'][0]}', 1), lambda x: length(x) > 5 AND NOT regexp_matches(x, '{_IOC_RX['ip'][0]}')))) FROM ok),
    t AS (SELECT *, CASE WHEN kind = 'hash' THEN CASE length(value) WHEN 64 THEN 'hash_sha256' WHEN 40 THEN 'hash_sha1' ELSE 'hash_md5' END ELSE kind END AS ioc_type FROM v)
    SELECT text_id, ioc_type, value AS ioc_value, round(confidence, 4) AS confidence, CASE ioc_type WHEN 'ip' THEN concat('[ipv4-addr:value = ''', value, ''']')
      WHEN 'domain' THEN concat('[domain-name:value = ''', value, ''']') WHEN 'hash_sha256' THEN concat('[file:hashes.''SHA-256'' = ''', value, ''']')
      WHEN 'hash_sha1' THEN concat('[file:hashes.''SHA-1'' = ''', value, ''']') ELSE concat('[file:hashes.MD5 = ''', value, ''']') END AS pattern,
      CASE WHEN kind = 'hash' THEN 'malicious-activity,malware' ELSE 'malicious-activity,c2' END AS labels FROM t""",
)
def published_indicators(t: Tables) -> DataFrame:
    e = _ioc_texts(t).select(F.col("text_id").alias("event_id"), "text", ((F.length("text") % 41) / F.lit(40.0)).alias("confidence"))
    rows = federation.published(federation.without_personal_fields(e), "text", F.lit("2024-01-01T00:00:00Z"), "org-a")
    return rows.select(F.col("event_id").alias("text_id"), "ioc_type", "ioc_value", "confidence", "pattern", F.array_join("labels", ",").alias("labels"))


@query(
    "F-10 F-25 J-08 P-27 S-36",
    f"""WITH i AS (SELECT doc_id, doc_id % 120 AS v FROM documents WHERE doc_id % 5 >= 2), s AS ({_IOC_TEXT_SQL}),
    e AS (SELECT text_id, list_distinct(list_transform(list_filter(regexp_extract_all(text, '{_IOC_RX['ip'][0]}', 1), lambda x: NOT regexp_matches(x, '{_PRIV_SHARE}')), lambda x: lower(x))) AS vals FROM s),
    x AS (SELECT text_id, unnest(vals) AS v FROM e), m AS (SELECT text_id, count(*) AS matches FROM x JOIN i ON x.v = concat('203.0.113.', CAST(i.v AS STRING)) GROUP BY text_id)
    SELECT text_id, matches, round(least(1e-1 + 5e-2 * (matches - 1), 15e-2), 4) AS boost FROM m""",
)
def indicator_matches(t: Tables) -> DataFrame:
    indicators = t.documents.select(
        F.col("doc_id").alias("id"),
        F.format_string("[ipv4-addr:value = '203.0.113.%d']", F.col("doc_id") % 120).alias("pattern"),
        F.expr("CASE doc_id % 5 WHEN 0 THEN 'not a date' WHEN 1 THEN '2023-12-20T00:00:00Z' ELSE '2024-01-03T10:00:00Z' END").alias("created"),
    )
    e = _ioc_texts(t).select(F.col("text_id").alias("event_id"), "text")
    hits = federation.matched(e, text.public_ips(F.col("text")), indicators, F.lit("2024-01-10 00:00:00").cast("timestamp"))
    return hits.select(F.col("event_id").alias("text_id"), "matches", F.round("boost", 4).alias("boost"))


@query(
    "P-16 J-14",
    f"""WITH h AS ({d.HYPOTHESIS_SQL}), e AS (SELECT event_id, asset_id, value FROM ({d.EVENT_SQL})),
    hot AS (SELECT event_id, asset_id, value / 100 AS score FROM e WHERE value / 100 > 0.7)
    SELECT event_id, asset_id FROM hot WHERE NOT EXISTS (SELECT 1 FROM h WHERE state = 'ACTIVE_INVESTIGATION' AND contains(lower(goal), lower(hot.asset_id)))""",
)
def hunt_triggers(t: Tables) -> DataFrame:
    hot = d.events(t).select("event_id", "asset_id", (F.col("value") / 100).alias("score")).where(F.col("score") > params.HUNT_THRESHOLD)
    open_ = d.hypotheses(t).where("state = 'ACTIVE_INVESTIGATION'").select("goal")
    return enrich.uncovered_by_goals(hot, "asset_id", open_, "goal").select("event_id", "asset_id")


_REP = {
    "value": "concat('203.0.113.', CAST(doc_id % 150 AS STRING))",
    "malicious": "CAST(doc_id % 7 AS INT)",
    "suspicious": "CAST(doc_id % 3 AS INT)",
    "undetected": "CAST(doc_id % 50 AS INT)",
    "harmless": "CAST(doc_id % 20 AS INT)",
    "hours_old": "doc_id % 48",
}


@query(
    "J-20 S-42 F-25 F-07",
    f"""WITH s AS ({_IOC_TEXT_SQL}), i AS (SELECT DISTINCT text_id, unnest(list_filter(regexp_extract_all(text, '{_IOC_RX['ip'][0]}', 1), lambda x: NOT regexp_matches(x, '{_PRIV}'))) AS value FROM s),
    r AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _REP.items())} FROM documents WHERE doc_id % 48 <= 24),
    l AS (SELECT value, arg_min(malicious, hours_old * 1000000 + doc_id) AS m, arg_min(suspicious, hours_old * 1000000 + doc_id) AS s, arg_min(undetected, hours_old * 1000000 + doc_id) AS u,
      arg_min(harmless, hours_old * 1000000 + doc_id) AS h, arg_min(doc_id, hours_old * 1000000 + doc_id) AS d FROM r GROUP BY value),
    x AS (SELECT text_id, i.value, CASE WHEN coalesce(m + s + u + h, 0) > 0 THEN round((m + s) / CAST(m + s + u + h AS DOUBLE), 4) ELSE 0e0 END AS base, coalesce(d % 4 = 0, false) AS risky FROM i LEFT JOIN l USING (value))
    SELECT text_id, value, round(CASE WHEN risky THEN least(1e0, base + 5e-2) ELSE base END, 5) AS hunt_score, substring(sha256(concat('ip::', value)), 1, 32) AS cache_key FROM x""",
)
def reputation_scores(t: Tables) -> DataFrame:
    iocs = _ioc_texts(t).select("text_id", F.explode(text.iocs(F.col("text"))).alias("i")).select("text_id", "i.type", "i.value").where("type = 'ip'")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    rep = t.documents.selectExpr("doc_id", *[f"{v} AS {k}" for k, v in _REP.items()]).select(
        F.lit("ip").alias("type"), "value", "malicious", "suspicious", "undetected", "harmless",
        F.array().cast("array<string>").alias("vulns"),
        F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("C2"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.timestamp_micros(F.unix_micros(now) - F.col("hours_old") * 3_600_000_000 + 1_000_000 - F.col("doc_id")).alias("cached_at"),
    )
    scored = enrich.with_reputation(iocs, rep, now)
    return scored.select("text_id", "value", F.round("hunt_score", 5).alias("hunt_score"), records.cache_key(F.col("type"), F.col("value")).alias("cache_key"))


# -- decisions and runs -------------------------------------------------------
@query(
    "J-09 P-15 S-28",
    f"""WITH d AS ({d.DECISION_SQL}), r AS (SELECT event_id, event_type, user_id, value, event_id * 2 AS decision_id, value > 90 AS flagged FROM events)
    SELECT event_id, r.decision_id, action_taken, status, (flagged OR (r.decision_id IS NOT NULL AND upper(coalesce(action_taken, '')) NOT IN ('MONITOR', 'NONE', ''))) AS effective_flag,
      (value / 100 > 0.6 OR upper(coalesce(action_taken, '')) NOT IN ('MONITOR', 'NONE', '')) AS run_flag
    FROM r LEFT JOIN d ON r.decision_id = d.decision_id""",
)
def runs_with_decisions(t: Tables) -> DataFrame:
    runs = t.events.selectExpr("event_id", "value", "event_id * 2 AS decision_id", "value > 90 AS flagged")
    out = tables.runs_with_decisions(runs, d.decisions(t))
    return out.select("event_id", "decision_id", "action_taken", "status", "effective_flag", scoring.run_flag(F.col("value") / 100, F.col("action_taken")).alias("run_flag"))


@query(
    "J-09 T-02",
    f"""WITH d AS ({d.DECISION_SQL}) SELECT event_id, event_type, action_taken FROM events LEFT JOIN d ON event_id * 2 = decision_id
    WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50""",
)
def newest_runs_of_source(t: Tables) -> DataFrame:
    runs = t.events.where("event_type = 'error'").selectExpr("event_id", "event_type", "ts", "event_id * 2 AS decision_id", "false AS flagged")
    top = tables.newest(runs, [F.desc("ts"), F.desc("event_id")], 50)
    return tables.runs_with_decisions(top, d.decisions(t)).select("event_id", "event_type", "action_taken")


@query(
    "J-10 U-03",
    """SELECT o_orderkey AS decision_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
    AND o_orderkey NOT IN (SELECT l_orderkey + 1 FROM lineitem WHERE l_returnflag = 'A')""",
)
def unreviewed_decisions(t: Tables) -> DataFrame:
    corrections = t.lineitem.selectExpr(
        "CASE WHEN l_returnflag = 'R' THEN l_orderkey END AS original_decision_id",
        "CASE WHEN l_returnflag = 'A' THEN l_orderkey + 1 END AS corrected_decision_id",
    )
    return tables.unreviewed(d.decisions(t).select("decision_id"), corrections)


@query(
    "P-22 T-02",
    f"""SELECT decision_id, action_taken, round(risk_score, 6) AS risk_score, CASE WHEN blast_radius < 0.3 THEN 'LOW' WHEN blast_radius < 0.7 THEN 'MEDIUM' ELSE 'HIGH' END AS blast_label
    FROM ({d.DECISION_SQL}) WHERE NOT human_reviewed AND status = 'pending' ORDER BY created_at DESC, decision_id LIMIT 50""",
)
def pending_decisions(t: Tables) -> DataFrame:
    pending = d.decisions(t).where("NOT human_reviewed AND status = 'pending'")
    top = tables.newest(pending, [F.desc("created_at"), F.col("decision_id")], 50)
    return top.select("decision_id", "action_taken", F.round("risk_score", 6).alias("risk_score"), records.blast_label(F.col("blast_radius")).alias("blast_label"))


@query(
    "P-23",
    f"""WITH d AS ({d.DECISION_SQL}) SELECT decision_id, status FROM d WHERE blast_radius >= 0.3 AND contains(lower(concat_ws(' ', action_taken, status, CAST(hypothesis_id AS STRING))), 'block')""",
)
def priority_search(t: Tables) -> DataFrame:
    x = d.decisions(t).where(F.col("blast_radius") >= 0.3)
    return x.where(tables.matches_search([F.col("action_taken"), F.col("status"), F.col("hypothesis_id").cast("string")], "BLOCK")).select("decision_id", "status")


@query(
    "P-24",
    """SELECT event_id, CAST(greatest(0, least(21600, epoch(ts)::BIGINT - CASE WHEN epoch(ts) < epoch(ts)::BIGINT THEN 1 ELSE 0 END + 21600 - epoch(TIMESTAMP '2024-01-15 12:00:00')::BIGINT)) AS BIGINT) AS seconds_left FROM events""",
)
def reporting_deadlines(t: Tables) -> DataFrame:
    return t.events.select("event_id", records.deadline_seconds(F.col("ts"), F.lit("2024-01-15 12:00:00").cast("timestamp")).alias("seconds_left"))


@query(
    "P-26 T-02",
    f"""SELECT hypothesis_id, goal FROM ({d.HYPOTHESIS_SQL}) WHERE state = 'CONFIRMED' AND contains(lower(concat_ws(' ', goal, mission_impact, replace(chain_text, ',', ' '))), 'machinery')
    ORDER BY hypothesis_id DESC LIMIT 20""",
)
def recalled_hypotheses(t: Tables) -> DataFrame:
    h = d.hypotheses(t).where("state = 'CONFIRMED'")
    hit = tables.matches_search([F.col("goal"), F.col("mission_impact"), F.array_join("chain", " ")], "Machinery")
    return tables.newest(h.where(hit), [F.desc("hypothesis_id")], 20).select("hypothesis_id", "goal")


_PROFILE = """SELECT 'A0' AS agent_id, ['Decision','Hypothesis'] AS bad_types, ['write_to_audit'] AS bad_actions, 'dict' AS want UNION ALL
  SELECT 'A1', ['Evidence'], ['execute_playbook'], 'Evidence' UNION ALL SELECT 'A2', ['Decision'], ['call_external_api'], 'Hypothesis'"""
_CALL = {
    "call_id": "event_id",
    "agent_id": "concat('A', CAST(user_id % 4 AS STRING))",
    "output_type": "CASE event_id % 4 WHEN 0 THEN 'Decision' WHEN 1 THEN 'Evidence' WHEN 2 THEN 'Hypothesis' ELSE 'dict' END",
    "action": "CASE event_type WHEN 'error' THEN 'Write_To_Audit' WHEN 'click' THEN 'EXECUTE_PLAYBOOK' ELSE 'read' END",
    "path": "CASE WHEN event_id % 9 = 0 THEN 'data/AUDIT_log.jsonl' ELSE 'tmp/x' END",
    "schema_ok": "event_id % 13 <> 0",
}
_call_sql = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in _CALL.items()) + " FROM events"


def _calls(t: Tables) -> DataFrame:
    return t.events.selectExpr(*[f"{v} AS {k}" for k, v in _CALL.items()], "unix_micros(CAST(ts AS TIMESTAMP)) AS micros")


def _profiles(t: Tables) -> DataFrame:
    rows = [
        ("A0", ["Decision", "Hypothesis"], ["write_to_audit"], ["data/audit_log.jsonl"], "dict"),
        ("A1", ["Evidence"], ["execute_playbook"], ["data/audit_log.jsonl"], "Evidence"),
        ("A2", ["Decision"], ["call_external_api"], ["data/audit_log.jsonl"], "Hypothesis"),
    ]
    schema = "agent_id string, forbidden_output_types array<string>, forbidden_actions array<string>, forbidden_paths array<string>, expected_output_schema string"
    return t.spark.createDataFrame(rows, schema)


_VIOLATION_SQL = f"""WITH p AS ({_PROFILE}), c AS (SELECT * FROM ({_call_sql}) JOIN p USING (agent_id)), v AS (
  SELECT call_id, agent_id, 'output_type_mismatch' AS violation, output_type AS actual, CASE WHEN output_type IN ('Decision', 'Hypothesis') THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM c WHERE list_contains(bad_types, output_type)
  UNION ALL SELECT call_id, agent_id, 'schema_validation_failure', want, 'WARN' FROM c WHERE want <> 'dict' AND NOT schema_ok
  UNION ALL SELECT call_id, agent_id, 'forbidden_action', action, 'CRITICAL' FROM c WHERE list_contains(bad_actions, lower(action))
  UNION ALL SELECT call_id, agent_id, 'forbidden_path_access', path, 'CRITICAL' FROM c WHERE contains(lower(path), 'data/audit_log.jsonl'))"""


@query("P-30 S-41", _VIOLATION_SQL + " SELECT * FROM v")
def policy_violations(t: Tables) -> DataFrame:
    return policy.policy_violations(_calls(t), _profiles(t))


@query(
    "A-22 S-41",
    _VIOLATION_SQL
    + ", b AS (SELECT agent_id, max(call_id) AS since FROM v WHERE severity = 'CRITICAL' AND agent_id <> 'A1' GROUP BY agent_id), "
    "r AS (SELECT 'A2' AS agent_id, max(event_id) AS rel FROM events) SELECT b.agent_id, since FROM b LEFT JOIN r USING (agent_id) WHERE rel IS NULL OR rel <= since",
)
def suspended_agents(t: Tables) -> DataFrame:
    v = policy.policy_violations(_calls(t), _profiles(t)).withColumn("seq", F.col("call_id"))
    releases = t.events.agg(F.max("event_id").alias("seq")).select(F.lit("A2").alias("agent_id"), "seq")
    return policy.suspended(v, releases, protected="A1")


@query(
    "W-02",
    """WITH c AS (SELECT event_id, concat('A', CAST(user_id % 4 AS STRING)) AS agent_id, epoch_us(ts) AS micros FROM events),
    w AS (SELECT *, count(*) OVER (PARTITION BY agent_id ORDER BY micros RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS calls FROM c)
    SELECT event_id, agent_id, calls FROM w WHERE calls > 5""",
)
def rate_violations(t: Tables) -> DataFrame:
    calls = _calls(t).select(F.col("call_id").alias("event_id"), "agent_id", "micros")
    limits = calls.select("agent_id").distinct().withColumn("max_calls_per_minute", F.lit(5))
    return policy.rate_violations(calls, limits, seconds=3600).select("event_id", "agent_id", "calls")


# -- attribution --------------------------------------------------------------
@query(
    "P-19 P-21",
    f"""WITH a AS ({d.ASSET_SQL}), x AS (SELECT s_suppkey, CASE WHEN contains(mission, 'exam_portal') THEN 8e-2 WHEN contains(mission, 'power_management') THEN 22e-2 WHEN contains(mission, 'patient_records') THEN 35e-2 ELSE 12e-2 END AS fp,
      CASE WHEN contains(mission, 'patient_records') THEN 'human_review' ELSE 'proceed' END AS recommendation,
      CASE WHEN contains(mission, 'exam_portal') THEN 'APT41' WHEN contains(mission, 'power_management') THEN 'RansomwareGroup' ELSE 'Unknown' END AS actor,
      CASE WHEN contains(mission, 'exam_portal') THEN 'T1595,T1190,T1059,T1003' WHEN contains(mission, 'power_management') THEN 'T1566,T1078,T1021,T1486,T1489' ELSE 'T1595,T1190,T1059' END AS chain FROM a)
    SELECT *, CASE WHEN fp + (s_suppkey % 3) / 5e0 > 0.5 THEN 'HUMAN_GATE' ELSE 'AUTO_RESPOND' END AS gated FROM x""",
)
def mission_rules(t: Tables) -> DataFrame:
    a = d.assets(t).withColumn("c", attribution.critic_rule(F.col("mission"))).withColumn("r", attribution.attribution_rule(F.col("mission")))
    gate = scoring.critic_gate(F.lit("AUTO_RESPOND"), F.col("c.false_positive") + (F.col("s_suppkey") % 3) / F.lit(5.0))
    return a.select(
        "s_suppkey", F.col("c.false_positive").alias("fp"), "c.recommendation", "r.actor", F.array_join("r.chain", ",").alias("chain"), gate.alias("gated")
    )


@query(
    "A-06",
    """WITH x AS (SELECT l_orderkey AS event_id, concat('G', CAST(l_suppkey % 4 AS STRING)) AS actor, 85e-2 * (l_discount + l_extendedprice / 1e6) AS w FROM lineitem WHERE l_suppkey % 5 <> 4
      UNION ALL SELECT o_orderkey, concat('G', CAST(o_custkey % 6 AS STRING)), 8e-1 * (o_orderkey % 97 + 1) / 97e0 FROM orders),
    s AS (SELECT event_id, actor, sum(w) AS w FROM x GROUP BY event_id, actor),
    r AS (SELECT event_id, actor, w / sum(w) OVER (PARTITION BY event_id) AS share, row_number() OVER (PARTITION BY event_id ORDER BY round(w, 9) DESC, actor) AS rank FROM s)
    SELECT event_id, count(*) AS kept, round(sum(round(share, 3)), 3) AS share_sum, max(CASE WHEN rank = 1 THEN round(share, 3) END) AS top_share FROM r WHERE rank <= 2 GROUP BY event_id""",
)
def attribution_votes(t: Tables) -> DataFrame:
    docs = t.lineitem.selectExpr(
        "l_orderkey AS event_id", "CASE WHEN l_suppkey % 5 <> 4 THEN concat('G', CAST(l_suppkey % 4 AS STRING)) ELSE 'Unknown' END AS actor",
        "CAST(NULL AS DOUBLE) AS trust", "l_discount + l_extendedprice / 1e6 AS similarity",
    )
    votes = t.orders.selectExpr("o_orderkey AS event_id", "concat('G', CAST(o_custkey % 6 AS STRING)) AS actor", "(o_orderkey % 97 + 1) / 97e0 AS confidence")
    ranked = attribution.attribution_vote(docs, votes)
    return ranked.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("kept"), F.round(F.sum("share"), 3).alias("share_sum"), F.max(F.when(F.col("rank") == 1, F.col("share"))).alias("top_share")
    )


_EMBED = (
    "list_transform(range(0, 384), lambda i: coalesce(list_sum(list_transform(range(i, len(chars), 384), "
    "lambda j: unicode(chars[j + 1]) / 128e0)), 0e0))"
)
_CHARS = "list_filter(string_split(text, ''), lambda c: c <> '')"


@query(
    "J-15 S-16 F-28 F-32 U-01",
    f"""WITH q AS (SELECT s_suppkey AS query_id, concat('Attack GET to /', type, ' from ', ip, ' targeting ', mission, ' criticality ', criticality, ' OT None') AS text FROM ({d.ASSET_SQL})),
    c AS (SELECT doc_id, concat_ws(' ', nullif(source, ''), nullif(text, '')) AS text, CASE lang WHEN 'en' THEN 9e-1 WHEN 'fr' THEN 85e-2 WHEN 'de' THEN 95e-2 ELSE 85e-2 END AS trust_weight FROM documents),
    qe AS (SELECT query_id, {_EMBED} AS e FROM (SELECT *, {_CHARS} AS chars FROM q)), ce AS (SELECT doc_id, trust_weight, {_EMBED} AS e FROM (SELECT *, {_CHARS} AS chars FROM c)),
    p AS (SELECT query_id, doc_id, trust_weight, list_cosine_similarity(qe.e, ce.e) AS similarity FROM qe, ce),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 12) DESC, doc_id) AS rank FROM p)
    SELECT query_id, doc_id, rank, round(similarity, 5) AS similarity, trust_weight FROM r WHERE rank <= 5""",
)
def retrieved_documents(t: Tables) -> DataFrame:
    part = lambda *langs: t.documents.where(F.col("lang").isin(*langs)).select(
        "doc_id", F.col("source").alias("name"), F.col("text").alias("description")
    )
    docs = attribution.corpus({"MITRE": part("en"), "NVD": part("fr", "es"), "CERT-In": part("de")}).select("doc_id", "text", "trust_weight")
    a = d.assets(t)
    q = a.select(
        F.col("s_suppkey").alias("query_id"),
        attribution.retrieval_query(F.lit("GET"), F.concat(F.lit("/"), "type"), F.col("ip"), F.col("mission"), F.col("criticality"), F.lit(None).cast("string")).alias("text"),
    )
    found = attribution.retrieved(q, docs, 5)
    return found.join(docs.select(F.col("doc_id").alias("vector_id"), "trust_weight"), "vector_id").select(
        "query_id", F.col("vector_id").alias("doc_id"), "rank", F.round("similarity", 5).alias("similarity"), "trust_weight"
    )


@query("J-16 S-17 F-27 F-26")
def campaign_matches(t: Tables) -> DataFrame:
    sequences = t.nation.select(
        F.col("n_nationkey").cast("bigint").alias("campaign_id"), F.concat(F.lit("campaign-"), "n_nationkey").alias("name"),
        F.expr(
            "CASE n_nationkey % 5 WHEN 0 THEN array('T1595','T1190','T1059','T1003','T1486') WHEN 1 THEN array('T1566','T1078','T1021') "
            "WHEN 2 THEN array('T1486','T1489') WHEN 3 THEN array('T1499','T1021','T1003') ELSE array('T1190','T1204','T1059') END"
        ).alias("ttp_sequence"),
    ).withColumn(
        "preventive_actions", F.map_from_arrays("ttp_sequence", F.transform("ttp_sequence", lambda x: F.concat(F.lit("block-"), x)))
    )
    h = d.hypotheses(t)
    found = attribution.campaign_matches(h, sequences)
    blend = scoring.attribution_blend(F.lit(0.65), F.coalesce("match_confidence", F.lit(0.0)))
    named = found.withColumnRenamed("confidence", "match_confidence")
    return h.join(named, "chain", "left").withColumn("b", blend).select(
        "hypothesis_id", "campaign", F.round("match_confidence", 4).alias("match_confidence"), "predicted_next", "preventive_action", "b.confidence", "b.uncertainty", "b.move_confidence"
    )
