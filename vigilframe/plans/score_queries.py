"""Queries: features, scores, decisions, windows, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.functions import features, records, scoring
from vigilframe.operators import anomaly, audit, evaluate, report, running, tables
from vigilframe.plans import derived as d
from vigilframe.plans.registry import Tables, query
from vigilframe.session import cut_lineage, scratch_path

_DAY = 86_400


def _flow_record() -> dict:
    names = ["bytes", "src_port", "dst_port", "flow_duration", "fwd_packets", "bwd_packets", "protocol", "status"]
    return {**{n: F.col(n) for n in names}, "timestamp": F.col("seen_at")}


_RAW_SQL = {
    "bytes": "bytes", "src_port": "CAST(src_port AS DOUBLE)", "dst_port": "CAST(dst_port AS DOUBLE)", "flow_duration": "flow_duration",
    "fwd_packets": "fwd_packets", "bwd_packets": "CAST(bwd_packets AS DOUBLE)",
    "protocol_tcp": "CASE WHEN protocol = 'TCP' THEN 1e0 ELSE 0e0 END", "protocol_udp": "CASE WHEN protocol = '17' THEN 1e0 ELSE 0e0 END",
    "protocol_icmp": "CASE WHEN protocol = 'icmp' THEN 1e0 ELSE 0e0 END", "status_code": "CAST(status AS DOUBLE)",
    "hour_of_day": "CAST(hour(seen_at) AS DOUBLE)", "day_of_week": "CAST(isodow(seen_at) - 1 AS DOUBLE)",
    "is_off_hours": "CASE WHEN hour(seen_at) >= 18 OR hour(seen_at) < 9 THEN 1e0 ELSE 0e0 END",
    "is_night": "CASE WHEN hour(seen_at) >= 23 OR hour(seen_at) < 6 THEN 1e0 ELSE 0e0 END",
    "port_entropy": "abs(src_port - dst_port) / greatest(CAST(src_port + dst_port AS DOUBLE), 1e0)",
    "byte_rate": "CASE WHEN flow_duration > 0 THEN bytes / greatest(flow_duration / 1e6, 1e-3) ELSE 0e0 END",
    "packet_ratio": "fwd_packets / greatest(fwd_packets + bwd_packets, 1e0)",
    "is_privileged_port": "CASE WHEN dst_port < 1024 AND dst_port > 0 THEN 1e0 ELSE 0e0 END",
    "is_high_port": "CASE WHEN src_port > 49152 THEN 1e0 ELSE 0e0 END",
    "connection_density": "fwd_packets * bwd_packets",
}


@query(
    "F-12 S-05",
    f"WITH f AS ({d.FLOW_SQL}) SELECT flow_id, "
    + ", ".join(f"round({f'ln(1 + {e})' if n == 'byte_rate' else e}, 9) AS {n if n != 'byte_rate' else 'log_byte_rate'}" for n, e in _RAW_SQL.items())
    + " FROM f",
)
def raw_flow_features(t: Tables) -> DataFrame:
    feats = features.raw_features(_flow_record())
    feats["log_byte_rate"] = F.log1p(feats.pop("byte_rate"))
    return d.flows(t).select("flow_id", *[F.round(c, 9).alias(n) for n, c in feats.items()])


_clip = lambda e, lo, hi: f"greatest({lo}, least({hi}, {e}))"
_SCALED_SQL = {
    "bytes": _clip("bytes / 1e6", "0e0", "1e0"), "src_port": "src_port / 65535e0", "dst_port": "dst_port / 65535e0",
    "flow_duration": _clip("flow_duration / 1e8", "0e0", "1e0"), "fwd_packets": "fwd_packets / 1e4", "bwd_packets": "bwd_packets / 1e4",
    "protocol_tcp": "CASE WHEN proto_number = 6 THEN 1e0 ELSE 0e0 END", "protocol_udp": "CASE WHEN proto_number = 17 THEN 1e0 ELSE 0e0 END",
    "protocol_icmp": "CASE WHEN proto_number = 1 THEN 1e0 ELSE 0e0 END", "status_code": "0e0",
    "hour_of_day": "hour(seen_at) / 23e0", "day_of_week": "(isodow(seen_at) - 1) / 6e0",
    "is_off_hours": "CASE WHEN hour(seen_at) < 8 OR hour(seen_at) >= 18 THEN 1e0 ELSE 0e0 END",
    "is_night": "CASE WHEN hour(seen_at) < 6 OR hour(seen_at) >= 22 THEN 1e0 ELSE 0e0 END",
    "port_entropy": "ln(1 + greatest(abs(dst_port - src_port), 1)) / ln(65536e0)",
    "byte_rate": _clip("bytes / greatest(flow_duration / 1e6, 1e-3) / 1e9", "0e0", "1e0"),
    "packet_ratio": "fwd_packets / (fwd_packets + bwd_packets + 1e-6)",
    "is_privileged_port": "CASE WHEN dst_port < 1024 THEN 1e0 ELSE 0e0 END", "is_high_port": "CASE WHEN dst_port >= 49152 THEN 1e0 ELSE 0e0 END",
    "connection_density": _clip("(fwd_packets + bwd_packets + 1e-6) / greatest(flow_duration / 1e6, 1e-3) / 1e6", "0e0", "1e0"),
}
_ENTROPY_SQL = """c AS (SELECT src, dst_port, src_port % 50 AS item, dst FROM f), p AS (SELECT src, item, count(*) AS n FROM c GROUP BY src, item),
  s AS (SELECT src, sum(n) AS tot FROM p GROUP BY src), en AS (SELECT p.src, -sum(n / CAST(tot AS DOUBLE) * log2(n / CAST(tot AS DOUBLE))) AS entropy FROM p JOIN s USING (src) GROUP BY p.src),
  ds AS (SELECT src, count(DISTINCT dst) AS destinations FROM c GROUP BY src)"""


@query(
    "F-13 F-14 J-17 S-40",
    f"WITH f AS ({d.FLOW_SQL}), {_ENTROPY_SQL} SELECT flow_id, "
    + ", ".join(f"round({e}, 9) AS {n}" for n, e in _SCALED_SQL.items())
    + ", round(least(20e0, (l_quantity_syn) / 2e0) / 20e0, 9) AS syn_ack_ratio, round(least(1e0, bytes / 1e6), 9) AS packet_length_variance, "
    "round(least(1e0, status / greatest(fwd_packets + bwd_packets, 1e0)), 9) AS rst_rate, round(entropy / 16e0, 9) AS source_port_entropy, "
    "round(least(1e0, destinations / 1e3), 9) AS source_destinations FROM (SELECT *, fwd_packets AS l_quantity_syn FROM f) JOIN en USING (src) JOIN ds USING (src)",
)
def training_features(t: Tables) -> DataFrame:
    f = d.flows(t)
    per = evaluate.entropy_by_source(f.withColumn("item", F.col("src_port") % 50), "src", "item", "dst")
    rec = {**_flow_record(), "protocol": F.col("proto_number")}
    extras = features.forest_extras(
        {**rec, "syn_flag": F.col("fwd_packets"), "ack_flag": F.lit(1), "pkt_len_var": F.col("bytes"), "rst_flag": F.col("status")},
        F.col("entropy"), F.col("destinations"),
    )
    cols = {**features.scaled_features(rec), **extras}
    return f.join(per, "src").select("flow_id", *[F.round(c, 9).alias(n) for n, c in cols.items()])


@query(
    "A-08",
    f"WITH f AS (SELECT user_id AS src, event_type AS item, CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst FROM events), "
    "p AS (SELECT src, item, count(*) AS n FROM f GROUP BY src, item), s AS (SELECT src, sum(n) AS tot FROM p GROUP BY src), "
    "en AS (SELECT p.src, -sum(n / CAST(tot AS DOUBLE) * log2(n / CAST(tot AS DOUBLE))) AS entropy FROM p JOIN s USING (src) GROUP BY p.src) "
    "SELECT src AS user_id, round(entropy, 6) AS entropy, (SELECT count(DISTINCT dst) FROM f WHERE f.src = en.src) AS destinations FROM en",
)
def entropy_by_source(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return evaluate.entropy_by_source(e, "user_id", "event_type", "k").select("user_id", F.round("entropy", 6).alias("entropy"), "destinations")


_SIG_SQL = (
    "SELECT page_id, url, length(url) AS n, lower(url) AS low FROM pages"
)


@query(
    "F-15",
    f"WITH p AS ({_SIG_SQL}), ch AS (SELECT page_id, n, unnest(string_split(low, '')) AS c FROM p), k AS (SELECT page_id, n, c, count(*) AS k FROM ch GROUP BY page_id, n, c), "
    "e AS (SELECT page_id, -sum(k / CAST(n AS DOUBLE) * log2(k / CAST(n AS DOUBLE))) AS ent FROM k GROUP BY page_id) "
    "SELECT page_id, round(n / 100e0, 6) AS domain_length, round(ent / 5, 6) AS domain_entropy, CASE WHEN n > 50 THEN 1e0 ELSE 0e0 END AS long_domain, "
    "CASE WHEN page_id % 3 = 0 THEN 1e0 ELSE 0e0 END AS failed_auth, CASE WHEN page_id % 2 = 0 THEN 1e0 ELSE 0e0 END AS admin, round((page_id % 9) / 10e0, 6) AS logon, "
    "CASE WHEN page_id % 4 = 1 THEN 1e0 ELSE 0e0 END AS suspicious, CASE WHEN page_id % 5 = 2 THEN 1e0 ELSE 0e0 END AS unusual_port FROM p JOIN e USING (page_id)",
)
def signal_vectors(t: Tables) -> DataFrame:
    p = t.pages
    rec = {
        "path": F.col("url"),
        "user": F.when(F.col("page_id") % 2 == 0, "ADMIN-1").otherwise("joe"),
        "status": F.when(F.col("page_id") % 3 == 0, "401").otherwise("200"),
        "logon_type": F.when(F.col("page_id") % 9 == 3, F.lit("3")).otherwise((F.col("page_id") % 9).cast("string")),
        "method": F.when(F.col("page_id") % 4 == 1, "PowerShell.exe").otherwise("GET"),
        "dst_port": F.when(F.col("page_id") % 5 == 2, "4444").otherwise("80"),
    }
    s = features.signals(rec)
    at = lambda name, i: F.element_at(s[name], i)
    return p.select(
        "page_id", F.round(at("dns", 1), 6).alias("domain_length"), F.round(at("dns", 2), 6).alias("domain_entropy"), at("dns", 4).alias("long_domain"),
        at("auth", 1).alias("failed_auth"), at("auth", 2).alias("admin"), F.round(at("auth", 3), 6).alias("logon"),
        at("process", 2).alias("suspicious"), at("network", 7).alias("unusual_port"),
    )


@query("F-16 F-15")
def fused_signals(t: Tables) -> DataFrame:
    s = features.signals(_flow_record())
    flat = F.concat(*[s[n] for n in anomaly.SIGNAL_NAMES])
    fused = anomaly.with_fusion(d.flows(t), flat)
    return fused.select(
        "flow_id", F.round("fused_score", 5).alias("fused_score"),
        *[F.element_at("signal_weights", i + 1).alias(f"weight_{n}") for i, n in enumerate(anomaly.SIGNAL_NAMES)],
    )


@query("F-17 F-12")
def behaviour_embeddings(t: Tables) -> DataFrame:
    feats = F.array(*features.raw_features(_flow_record()).values())
    e = anomaly.with_embedding(d.flows(t).select("flow_id", feats.alias("f")), F.col("f"))
    return e.select("flow_id", F.size("behaviour").cast("bigint").alias("dim"), *[F.round(F.element_at("behaviour", i), 4).alias(f"e{i}") for i in (1, 128, 256)])


# -- score expressions ---------------------------------------------------------
@query(
    "P-13 P-14",
    f"""WITH a AS ({d.ASSET_SQL}), x AS (SELECT s_suppkey, CASE WHEN NOT can_reboot THEN 13e-1 WHEN safety_critical THEN 7e-1 WHEN impact_if_compromised = 'CRITICAL' THEN 8e-1 WHEN impact_if_compromised = 'HIGH' THEN 9e-1
      WHEN impact_if_compromised = 'LOW' THEN 11e-1 ELSE 1e0 END AS multiplier, (s_suppkey % 89) / 89e0 AS score FROM a)
    SELECT s_suppkey, multiplier, score >= 5e-1 * multiplier AS autonomous, false AS observed, score >= 5e-1 * multiplier AS supervised, false AS supervised_action FROM x""",
)
def threshold_gates(t: Tables) -> DataFrame:
    a = d.assets(t).withColumn("multiplier", scoring.threshold_multiplier(F.col("can_reboot"), F.col("safety_critical"), F.col("impact_if_compromised")))
    gate = lambda mode: scoring.anomaly_gate((F.col("s_suppkey") % 89) / F.lit(89.0), F.lit(0.5) * F.col("multiplier"), mode)
    return a.select(
        "s_suppkey", "multiplier", gate("AUTONOMOUS")["is_anomalous"].alias("autonomous"), gate("OBSERVE_ONLY")["is_anomalous"].alias("observed"),
        gate("SUPERVISED_HYBRID")["is_anomalous"].alias("supervised"), gate("SUPERVISED_HYBRID")["action_allowed"].alias("supervised_action"),
    )


_POST = "(greatest(supporting, 1) / CAST(greatest(supporting, 1) + 1 AS DOUBLE)) * (1 - uncertainty) * confidence"
_DECIDE_SQL = f"""WITH h AS ({d.HYPOTHESIS_SQL}), a AS ({d.ASSET_SQL}),
 x AS (SELECT h.*, a.asset_id IS NOT NULL AS known, a.criticality, a.internet_facing, a.can_reboot, a.safety_critical, a.mission, {_POST} AS own,
   CASE WHEN hypothesis_id % 3 = 0 THEN 5e-1 * 5e-1 * 4e-1 WHEN hypothesis_id % 3 = 1 THEN 5e-1 * 5e-1 * 3e-1 + (2 / 3e0) * 5e-1 * 2e-1 ELSE 0e0 END AS rivals
   FROM h LEFT JOIN a ON h.asset_id = a.asset_id),
 p AS (SELECT *, greatest(0e0, least(1e0, own / (own + rivals + 3e-1 * greatest(1e-2, 1 - confidence)))) AS posterior, (hypothesis_id % 61) / 100e0 AS blast,
   CASE WHEN hypothesis_id % 4 = 0 THEN (hypothesis_id % 8 = 0) OR (hypothesis_id % 20 = 0) ELSE (NOT known OR NOT coalesce(can_reboot, true) OR coalesce(safety_critical, false)) END AS gated FROM x),
 q AS (SELECT *, CASE WHEN gated THEN 'HUMAN_GATE' WHEN posterior <= 0.5 THEN 'MONITOR' WHEN blast > 0.3 THEN 'HUMAN_GATE' ELSE 'AUTO_RESPOND' END AS decision,
   CASE WHEN posterior <= 0.2 THEN 'MONITOR' WHEN blast > 0.3 THEN 'HUMAN_GATE' ELSE 'AUTO_RESPOND' END AS demo_decision, string_split(chain_text, ',') AS c FROM p)
 SELECT hypothesis_id, round(posterior, 9) AS posterior, decision, demo_decision,
   CASE decision WHEN 'MONITOR' THEN 'MONITOR' WHEN 'HUMAN_GATE' THEN CASE WHEN list_contains(c, 'T1486') THEN 'ISOLATE_HOST' WHEN list_contains(c, 'T1003') OR list_contains(c, 'T1078') THEN 'REVOKE_SESSION' ELSE 'NOTIFY_SOC' END || ' (PENDING HUMAN APPROVAL)'
     ELSE CASE WHEN list_contains(c, 'T1486') THEN 'ISOLATE_HOST' WHEN list_contains(c, 'T1190') THEN 'BLOCK_IP' WHEN list_contains(c, 'T1003') OR list_contains(c, 'T1078') THEN 'REVOKE_SESSION' ELSE 'BLOCK_IP' END END AS action,
   round(least(1e0, uncertainty * CASE criticality WHEN 'CRITICAL' THEN 1e0 WHEN 'HIGH' THEN 75e-2 WHEN 'LOW' THEN 25e-2 ELSE 5e-1 END * CASE WHEN coalesce(internet_facing, false) THEN 1e0 ELSE 4e-1 END * greatest(0e0, least(1e0, confidence))), 9) AS risk
 FROM q"""


@query("P-17 P-18 F-23 F-24 J-01", _DECIDE_SQL)
def response_decisions(t: Tables) -> DataFrame:
    a = d.assets(t).select("asset_id", "criticality", "internet_facing", "can_reboot", "safety_critical", F.lit(True).alias("known"))
    h = d.hypotheses(t).join(a, "asset_id", "left")
    k = F.col("hypothesis_id")
    rival = lambda c, n: F.struct(F.lit(c).alias("confidence"), F.array(*[F.lit(str(i)) for i in range(n)]).cast("array<string>").alias("evidence_refs"))
    rivals = F.when(k % 3 == 0, F.array(rival(0.4, 0))).when(k % 3 == 1, F.array(rival(0.3, 1), rival(0.2, 2))).otherwise(F.array().cast("array<struct<confidence:double,evidence_refs:array<string>>>"))
    supporting = F.when(F.col("supporting") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("supporting"))).otherwise(F.array().cast("array<bigint>"))
    model = F.when(
        k % 4 == 0,
        F.struct(
            F.when(k % 8 == 0, "railway").otherwise("education").alias("industry"),
            F.create_map(F.lit("can_reboot"), k % 20 != 0).alias("safety_constraints"),
        ),
    )
    asset = F.when(F.col("known"), F.struct("can_reboot", "safety_critical"))
    p = h.withColumn("posterior", scoring.posterior(supporting, F.col("uncertainty"), F.col("confidence"), rivals, digits=9))
    gated, blast = scoring.safety_gate(model, asset), (k % 61) / F.lit(100.0)
    from vigilframe.params import DEMONSTRATION

    p = p.withColumn("decision", scoring.decision_rule(F.col("posterior"), blast, gated)).withColumn(
        "demo_decision", scoring.decision_rule(F.col("posterior"), blast, gated, DEMONSTRATION)
    )
    return p.select(
        "hypothesis_id", "posterior", "decision", "demo_decision",
        scoring.response_action(F.col("decision"), F.col("chain")).alias("action"),
        scoring.risk(F.col("uncertainty"), F.col("criticality"), F.col("internet_facing"), F.col("confidence"), digits=9).alias("risk"),
    )


@query(
    "F-20 F-19",
    """WITH x AS (SELECT event_id, (event_id % 101) / 101e0 AS a, (event_id % 53) / 53e0 AS b, value / 500 AS c, (user_id % 29) / 29e0 AS e, (event_id % 17) / 17e0 AS u FROM events),
    y AS (SELECT *, 6e-1 * (4e-1 * ((a + c) / 2) + 6e-1 * b) + 4e-1 * e AS s, (a + b + c + e) / 4 AS m FROM x),
    z AS (SELECT *, least(sqrt(((a-m)*(a-m) + (b-m)*(b-m) + (c-m)*(c-m) + (e-m)*(e-m)) / 4) / 5e-1, 1e0) AS al FROM y)
    SELECT event_id, round(s, 6) AS anomaly_score, round(al, 6) AS aleatoric, round(5e-1 * u + 5e-1 * al, 6) AS uncertainty, round((1 - (5e-1 * u + 5e-1 * al)) * s, 6) AS effective_confidence, round(1 / (1 + exp((a - b) / 7e-1)), 6) AS boundary FROM z""",
)
def ensemble_scores(t: Tables) -> DataFrame:
    x = t.events.selectExpr("event_id", "(event_id % 101) / 101e0 AS a", "(event_id % 53) / 53e0 AS b", "value / 500 AS c", "(user_id % 29) / 29e0 AS e", "(event_id % 17) / 17e0 AS u")
    c = F.col
    e = x.withColumn("s", scoring.ensemble(c("a"), c("b"), c("c"), c("e"), c("u")))
    return e.select(
        "event_id", *[F.round(c("s")[n], 6).alias(n) for n in ("anomaly_score", "aleatoric", "uncertainty", "effective_confidence")],
        F.round(scoring.boundary_score(c("a") - c("b"), F.lit(0.7)), 6).alias("boundary"),
    )


@query(
    "F-21 F-25 F-30 U-04",
    f"""WITH h AS ({d.HYPOTHESIS_SQL}) SELECT hypothesis_id, round(confidence * exp(-2e-2 * (hypothesis_id % 48)), 6) AS decayed,
     round(least(1e0, confidence + hypothesis_id / 3e7 + round(5e-2 + 1e-1 * ((hypothesis_id % 13) / 13e0), 4)), 4) AS hunted,
     round(least(1e0, confidence + hypothesis_id / 3e7 + CASE WHEN hypothesis_id % 4 = 0 THEN 0e0 ELSE least(1e-1 + 5e-2 * (hypothesis_id % 4 - 1), 15e-2) END), 4) AS federated,
     CASE WHEN 6e-1 > confidence AND 6e-1 >= (hypothesis_id % 10) / 10e0 THEN 'rival-a' WHEN (hypothesis_id % 10) / 10e0 > confidence THEN 'rival-b' ELSE goal END AS primary_goal,
     supporting + CASE WHEN hypothesis_id % 3 >= supporting THEN 1 ELSE 0 END AS evidence FROM h""",
)
def confidence_updates(t: Tables) -> DataFrame:
    h, k = d.hypotheses(t), F.col("hypothesis_id")
    rivals = F.array(
        F.struct(F.lit("rival-a").alias("goal"), F.lit(0.6).alias("confidence")),
        F.struct(F.lit("rival-b").alias("goal"), ((k % 10) / F.lit(10.0)).alias("confidence")),
    )
    linked = F.transform(F.slice(F.array(*[F.lit(i) for i in range(5)]), 1, F.col("supporting").cast("int")), lambda i: i.cast("string"))
    return h.select(
        "hypothesis_id", F.round(scoring.decayed(F.col("confidence"), F.lit(0.02), (k % 48).cast("double")), 6).alias("decayed"),
        scoring.boosted_in_order(F.col("confidence") + k / F.lit(3e7), F.array((k % 13) / F.lit(13.0))).alias("hunted"),
        scoring.boosted(F.col("confidence") + k / F.lit(3e7), scoring.federation_boost(k % 4)).alias("federated"),
        scoring.primary_goal(F.col("goal"), F.col("confidence"), rivals).alias("primary_goal"),
        F.size(records.appended(linked, (k % 3).cast("string"))).cast("bigint").alias("evidence"),
    )


@query(
    "F-33",
    """SELECT event_id, round(greatest(0e0, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 00:00:00')) / 1e6), 3) AS seconds,
    round(sin(greatest(0e0, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 00:00:00')) / 1e6) * exp(2 * (-ln(10000e0) / 16))), 5) AS code_2,
    round(cos(greatest(0e0, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10 00:00:00')) / 1e6) * exp(14 * (-ln(10000e0) / 16))), 5) AS code_15 FROM events""",
)
def time_codes(t: Tables) -> DataFrame:
    s = records.elapsed_seconds(F.col("ts"), F.lit("2024-01-10 00:00:00").cast("timestamp"))
    x = t.events.select("event_id", s.alias("s")).withColumn("c", records.time_code(F.col("s")))
    return x.select("event_id", F.round("s", 3).alias("seconds"), F.round(F.element_at("c", 3), 5).alias("code_2"), F.round(F.element_at("c", 16), 5).alias("code_15"))


# -- density, scaler, percentiles ----------------------------------------------
_PART_V = ["p_size", "p_retailprice", "w"]
_PART_SQL = "SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b, CAST((p_partkey * 7919) % 1013 AS DOUBLE) AS c FROM part"


def _parts(t: Tables) -> DataFrame:
    return t.part.selectExpr("p_partkey", "CAST(p_size AS DOUBLE) AS a", "p_retailprice AS b", "CAST((p_partkey * 7919) % 1013 AS DOUBLE) AS c")


_COV = (
    f"WITH x AS ({_PART_SQL}), m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, covar_samp(a, a) + 1e-6 AS aa, covar_samp(a, b) AS ab, covar_samp(a, c) AS ac, "
    "covar_samp(b, b) + 1e-6 AS bb, covar_samp(b, c) AS bc, covar_samp(c, c) + 1e-6 AS cc FROM x), "
    "dt AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m), "
    "g AS (SELECT p_partkey, sqrt(greatest(0e0, ((a - ma) * (a - ma) * (bb * cc - bc * bc) + (b - mb) * (b - mb) * (aa * cc - ac * ac) + (c - mc) * (c - mc) * (aa * bb - ab * ab) "
    "+ 2 * (a - ma) * (b - mb) * (ac * bc - ab * cc) + 2 * (a - ma) * (c - mc) * (ab * bc - ac * bb) + 2 * (b - mb) * (c - mc) * (ab * ac - aa * bc)) / det)) AS dist FROM x, dt), "
    "e AS (SELECT greatest(1e0, quantile_cont(dist, 0.99)) AS edge FROM g) "
)


@query("A-09 A-11 F-18 M-02", _COV + "SELECT p_partkey, round(dist, 5) AS distance, round(least(1e0, dist / edge), 5) AS density_score, round(1 - exp(-dist / edge), 5) AS epistemic FROM g, e")
def density_scores(t: Tables) -> DataFrame:
    p = _parts(t)
    scored = anomaly.density_scores(p, anomaly.fit_density(p, ["a", "b", "c"]))
    return scored.select("p_partkey", *[F.round(c, 5).alias(c) for c in ("distance", "density_score", "epistemic")])


@query(
    "A-10",
    f"WITH x AS ({_PART_SQL}) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS scale FROM x" for c in "abc"),
)
def feature_scaler(t: Tables) -> DataFrame:
    s = evaluate.scaler(_parts(t), ["a", "b", "c"])
    return s.select("feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@query(
    "A-11",
    "SELECT round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem",
)
def percentile_thresholds(t: Tables) -> DataFrame:
    marks = running.exact_quantiles(t.lineitem, F.col("l_extendedprice"), [0.05, 0.95, 0.99], direct=5_000)
    first = t.lineitem.agg(F.count(F.lit(1)).alias("n"))
    return first.select(*[F.round(F.lit(float(v)), 6).alias(n) for v, n in zip(marks, ("p05", "p95", "p99"))])


# -- windows -------------------------------------------------------------------
@query(
    "W-01 A-05",
    """WITH x AS (SELECT event_id, user_id, ts, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
    w AS (SELECT *, count(*) OVER o AS n, avg(value) OVER o AS m1, var_samp(value) OVER o AS v1, avg(k) OVER o AS m2, var_samp(k) OVER o AS v2 FROM x
      WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT event_id, n, round(m1, 8) AS mean_value, round(sqrt(v1), 5) AS std_value, round(m2, 8) AS mean_k,
      round(CASE WHEN n < 10 THEN 0e0 ELSE 1 - exp(-((abs(value - m1) / sqrt(greatest(v1, 1e-8)) + abs(k - m2) / sqrt(greatest(v2, 1e-8))) / 2) / 3) END, 5) AS temporal_score FROM w""",
)
def running_baselines(t: Tables) -> DataFrame:
    x = d.events(t).select("event_id", "user_id", "micros", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    s = anomaly.temporal_baseline(x, "user_id", "micros", "event_id", ["value", "k"])
    return s.select(
        "event_id", "n", F.round("mean_value", 8).alias("mean_value"), F.round(F.sqrt("var_value"), 5).alias("std_value"), F.round("mean_k", 8).alias("mean_k"),
        F.round("temporal_score", 5).alias("temporal_score"),
    )


@query(
    "W-05",
    """WITH x AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, value FROM events),
    s AS (SELECT seq, list(value) OVER (ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS l FROM x)
    SELECT seq, round(list_sum(l), 6) AS total, l[1] AS oldest, l[10] AS newest FROM s WHERE seq >= 10""",
)
def sliding_sequences(t: Tables) -> DataFrame:
    e = d.events(t)
    s = running.sliding_sequences(e, [F.col("micros"), F.col("event_id")], None, F.col("value"), 10)
    return s.select("seq", F.round(F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.element_at("sequence", 1).alias("oldest"), F.element_at("sequence", 10).alias("newest"))


@query(
    "W-09",
    """WITH f AS (SELECT user_id % 3 = 0 AS fitted, user_id, ts FROM events), c AS (SELECT user_id, count(*) AS rows, count(*) FILTER (NOT fitted OR ts > TIMESTAMP '2024-01-20') AS new_rows FROM f GROUP BY user_id)
    SELECT user_id, rows, new_rows, new_rows >= 60 AS due FROM c""",
)
def baseline_refits(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "ts")
    fits = e.where("user_id % 3 = 0").select("user_id").distinct().withColumn("fitted_at", F.lit("2024-01-20").cast("timestamp_ntz"))
    return anomaly.refit_due(e, "user_id", "ts", fits, min_rows=60)


@query(
    "W-06 W-10",
    """SELECT event_id, user_id, row_number() OVER o AS position, row_number() OVER o * 15 AS offset_seconds FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def incident_timelines(t: Tables) -> DataFrame:
    e = d.events(t)
    out = report.timeline(e, "user_id", [F.col("micros"), F.col("event_id")])
    return out.select("event_id", "user_id", "position", "offset_seconds")


@query(
    "W-07",
    "SELECT user_id, arg_max(event_id, epoch_us(ts)) AS event_id, arg_max(event_type, epoch_us(ts)) AS event_type FROM events GROUP BY user_id",
)
def latest_per_asset(t: Tables) -> DataFrame:
    return tables.latest(d.events(t).select("user_id", "event_id", "event_type", "micros"), ["user_id"], F.col("micros")).select("user_id", "event_id", "event_type")


_VER_SQL = """WITH x AS (SELECT o_custkey AS root_id, o_orderkey AS seq, CASE o_orderstatus WHEN 'O' THEN 'MODIFY' WHEN 'F' THEN 'REVOKE' ELSE 'ESCALATE' END AS kind, o_orderpriority AS act FROM orders),
 y AS (SELECT *, row_number() OVER w AS rn, string_agg(CASE kind WHEN 'MODIFY' THEN '-CORR' WHEN 'REVOKE' THEN '-REV' ELSE '-ESC' END, '') OVER (PARTITION BY root_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS suf FROM x WINDOW w AS (PARTITION BY root_id ORDER BY seq)),
 z AS (SELECT *, concat(CAST(root_id AS STRING), suf) AS decision_id FROM y)
 SELECT root_id, seq, decision_id, rn + 1 AS version, coalesce(lag(decision_id) OVER (PARTITION BY root_id ORDER BY seq), CAST(root_id AS STRING)) AS supersedes,
   concat(CASE kind WHEN 'REVOKE' THEN 'REVOKED:' WHEN 'ESCALATE' THEN 'ESCALATED:' ELSE 'MODIFIED:' END, act) AS action_taken FROM z"""


@query("W-08", _VER_SQL)
def decision_versions(t: Tables) -> DataFrame:
    c = t.orders.selectExpr(
        "o_custkey AS root_id", "o_orderkey AS seq", "CASE o_orderstatus WHEN 'O' THEN 'MODIFY' WHEN 'F' THEN 'REVOKE' ELSE 'ESCALATE' END AS correction_type", "o_orderpriority AS action_taken"
    )
    return audit.version_chain(c).select("root_id", "seq", "decision_id", "version", "supersedes", "action_taken")


_PAYLOAD_SQL = """concat('{"event_id":', CAST(event_id AS STRING), ',"event_type":"', event_type, '"}')"""
_CHAIN_SQL = f"""WITH RECURSIVE e AS (SELECT user_id, {_PAYLOAD_SQL} AS payload, CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) AS segment,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
 g AS (SELECT user_id, segment, min(seq) AS first_seq, sha256(string_agg(sha256(concat(CAST(seq AS STRING), '|', payload)), '' ORDER BY seq)) AS seal,
  row_number() OVER (PARTITION BY user_id ORDER BY segment) AS place FROM e GROUP BY user_id, segment),
 s AS (SELECT user_id, place, segment, first_seq, seal, CAST(NULL AS VARCHAR) AS start_hash FROM g WHERE place = 1
  UNION ALL SELECT g.user_id, g.place, g.segment, g.first_seq, g.seal, sha256(concat(coalesce(s.start_hash, ''), s.seal)) FROM s JOIN g ON g.user_id = s.user_id AND g.place = s.place + 1),
 c AS (SELECT e.user_id, e.segment, e.seq, s.start_hash AS prev_hash, sha256(concat(coalesce(s.start_hash, ''), e.payload)) AS entry_hash
   FROM e JOIN s ON e.user_id = s.user_id AND e.seq = s.first_seq
  UNION ALL SELECT e.user_id, e.segment, e.seq, c.entry_hash, sha256(concat(c.entry_hash, e.payload)) FROM c JOIN e ON e.user_id = c.user_id AND e.segment = c.segment AND e.seq = c.seq + 1)"""


def _event_chain(t: Tables) -> DataFrame:
    return audit.chained(d.events(t), "user_id", [F.col("micros"), F.col("event_id")], running.time_bucket(F.col("micros"), _DAY), ["event_id", "event_type"])


@query("W-04 S-22 F-07", _CHAIN_SQL + " SELECT user_id, seq, prev_hash, entry_hash FROM c")
def hash_chains(t: Tables) -> DataFrame:
    return _event_chain(t).select("user_id", "seq", "prev_hash", "entry_hash")


@query("W-04 S-22", _CHAIN_SQL + " SELECT user_id, seq, prev_hash, entry_hash FROM c")
def appended_chains(t: Tables) -> DataFrame:
    """The log of hash_chains, written in three appends that cut days and chains anywhere."""
    events, path = d.events(t), scratch_path(t.spark, "chains")
    low, high = events.agg(F.min("micros"), F.max("micros")).first()
    part = F.floor((F.col("micros") - F.lit(low)) * 3 / F.lit(high - low + 1))
    log = None
    for i in range(3):
        rows = audit.chained(events.where(part == i), "user_id", [F.col("micros"), F.col("event_id")], running.time_bucket(F.col("micros"), _DAY), ["event_id", "event_type"], log)
        rows.write.mode("append").parquet(path)
        log = t.spark.read.parquet(path)
    return log.select("user_id", "seq", "prev_hash", "entry_hash")


@query(
    "W-03 W-04 A-18",
    """WITH c AS (SELECT user_id, count(*) AS entries FROM events GROUP BY user_id),
    b AS (SELECT user_id, CASE WHEN user_id % 3 = 0 AND entries >= 5 THEN 5 WHEN user_id % 3 = 1 AND entries >= 4 THEN 4 END AS first_bad_seq, entries FROM c)
    SELECT user_id, entries, CAST(first_bad_seq AS BIGINT) AS first_bad_seq, first_bad_seq IS NULL AS valid FROM b""",
)
def chain_verification(t: Tables) -> DataFrame:
    log = cut_lineage(_event_chain(t))
    # two kinds of tampering: a changed payload, and a deleted entry
    log = log.withColumn("payload", F.when((F.col("user_id") % 3 == 0) & (F.col("seq") == 5), F.lit("{}")).otherwise(F.col("payload")))
    log = log.withColumn("prev_hash", F.when((F.col("user_id") % 3 == 1) & (F.col("seq") == 4), F.lit("00")).otherwise(F.col("prev_hash")))
    return audit.chain_report(log, "user_id")


def _tree_sql(levels: int = 26) -> str:
    """Roots of the hash trees, level by level; a last node without a neighbour goes up as it is."""
    steps = [
        f"m{k + 1} AS (SELECT event_type, i // 2 AS i, CASE WHEN count(*) = 2 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h FROM m{k} GROUP BY event_type, i // 2)"
        for k in range(levels)
    ]
    return f"""WITH e AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    m0 AS (SELECT event_type, seq - 1 AS i, sha256(concat(CAST(seq AS STRING), '|', '{{"event_id":', CAST(event_id AS STRING), '}}')) AS h FROM e), {", ".join(steps)}
    SELECT event_type, seq, m{levels}.h AS root, true AS proven, (SELECT count(*) FROM range({levels}) AS r(k) WHERE xor((e.seq - 1) >> k, 1) < ((e.n - 1) >> k) + 1) AS hashes
    FROM e JOIN m{levels} USING (event_type)"""


@query("W-03 A-18 F-07", _tree_sql())
def inclusion_proofs(t: Tables) -> DataFrame:
    """One hash tree per event type; every entry proved against its root."""
    rows = running.row_positions(d.events(t), ["event_type"], [F.col("micros"), F.col("event_id")]).withColumn("payload", audit.entry_payload(["event_id"]))
    log = cut_lineage(rows.select("event_type", "seq", F.lit(0).cast("bigint").alias("segment"), "payload"))
    proofs = audit.inclusion_proofs(log, "event_type")
    proven = audit.proves(F.col("digest"), F.col("path"), F.col("root"))
    return proofs.select("event_type", "seq", "root", proven.alias("proven"), F.size("path").cast("bigint").alias("hashes"))


@query(
    "A-07 W-07",
    """WITH v AS (SELECT l_orderkey AS decision_id, l_suppkey % 6 AS analyst_id, CASE l_suppkey % 4 WHEN 0 THEN 'senior' WHEN 1 THEN 'JUNIOR' WHEN 2 THEN 'external' ELSE 'guest' END AS role,
      CASE l_returnflag WHEN 'R' THEN 'REVOKE' WHEN 'A' THEN 'modify' ELSE 'ESCALATE' END AS kind, l_partkey * 10 + l_linenumber AS seq FROM lineitem),
    l AS (SELECT decision_id, analyst_id, arg_max(role, seq) AS role, arg_max(kind, seq) AS kind FROM v GROUP BY decision_id, analyst_id),
    p AS (SELECT o_orderkey AS decision_id, CASE o_orderstatus WHEN 'O' THEN 'MODIFY' WHEN 'F' THEN 'REVOKE' ELSE 'CONFIRM' END AS target_type FROM orders),
    w AS (SELECT *, CASE upper(role) WHEN 'SENIOR' THEN 9e-1 WHEN 'JUNIOR' THEN 3e-1 WHEN 'EXTERNAL' THEN 8e-1 ELSE 5e-1 END AS wt FROM l JOIN p USING (decision_id)),
    s AS (SELECT decision_id, target_type, count(*) AS voters, CASE WHEN target_type = 'CONFIRM' THEN 1e0 ELSE round(sum(CASE WHEN upper(kind) = target_type THEN wt ELSE 0e0 END) / sum(wt), 6) END AS consensus FROM w GROUP BY decision_id, target_type)
    SELECT *, CASE WHEN consensus >= 0.7 THEN 'APPLIED' ELSE 'PENDING_CONSENSUS' END AS outcome FROM s""",
)
def correction_consensus(t: Tables) -> DataFrame:
    votes = t.lineitem.selectExpr(
        "l_orderkey AS decision_id", "l_suppkey % 6 AS analyst_id",
        "CASE l_suppkey % 4 WHEN 0 THEN 'senior' WHEN 1 THEN 'JUNIOR' WHEN 2 THEN 'external' ELSE 'guest' END AS role",
        "CASE l_returnflag WHEN 'R' THEN 'REVOKE' WHEN 'A' THEN 'modify' ELSE 'ESCALATE' END AS correction_type", "l_partkey * 10 + l_linenumber AS seq",
    )
    proposed = t.orders.selectExpr("o_orderkey AS decision_id", "CASE o_orderstatus WHEN 'O' THEN 'MODIFY' WHEN 'F' THEN 'REVOKE' ELSE 'CONFIRM' END AS target_type")
    return audit.consensus(votes, proposed, digits=6)


@query(
    "A-26 S-24",
    """WITH m AS (SELECT o_custkey % 50 AS model, o_orderpriority AS metric, avg(o_totalprice) / 5e5 AS live, avg(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) / 5e5 AS shadow FROM orders GROUP BY 1, 2)
    SELECT model, CAST(min(CAST(shadow >= live * 95e-2 AS INT)) AS INT) = 1 AS promoted, CAST(sum(CAST(shadow < live * 95e-2 AS INT)) AS BIGINT) AS reasons FROM m GROUP BY model""",
)
def model_promotion(t: Tables) -> DataFrame:
    m = t.orders.groupBy((F.col("o_custkey") % 50).alias("model"), F.col("o_orderpriority").alias("metric")).agg(
        (F.avg("o_totalprice") / 5e5).alias("live"), (F.avg(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))) / 5e5).alias("shadow")
    )
    out = audit.promotion(m)
    return out.select("model", "promoted", F.size(F.filter(F.split("reasons", "; "), lambda r: r != "")).cast("bigint").alias("reasons"))
