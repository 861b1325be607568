"""Queries: statistics, reports, stores, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.functions import records
from vigilframe.operators import evaluate, federation, report, tables
from vigilframe.plans import derived as d
from vigilframe.plans.registry import Tables, query
from vigilframe.session import scratch_path
from vigilframe.sources import readers, writers

_CAT_SQL = (
    "CASE WHEN chain_text = '' THEN 'Unknown' WHEN contains(chain_text, 'T1566') THEN 'Phishing' WHEN contains(chain_text, 'T1486') THEN 'Ransomware' "
    "WHEN contains(chain_text, 'T1499') THEN 'DDoS' WHEN contains(chain_text, 'T1003') OR contains(chain_text, 'T1078') OR contains(chain_text, 'T1021') THEN 'Unauthorized Access' "
    "WHEN contains(chain_text, 'T1190') THEN 'Vulnerability Exploitation' WHEN contains(chain_text, 'T1204') OR contains(chain_text, 'T1059') THEN 'Malicious Code' "
    "WHEN contains(chain_text, 'T1595') THEN 'Network Scanning' ELSE 'Other' END"
)


@query("F-29", f"SELECT hypothesis_id, {_CAT_SQL} AS category FROM ({d.HYPOTHESIS_SQL})")
def incident_categories(t: Tables) -> DataFrame:
    return d.hypotheses(t).select("hypothesis_id", records.technique_category(F.col("chain")).alias("category"))


_STATS_SQL = f"""h AS (SELECT h.*, coalesce(a.sector, 'Unknown') AS sector, {_CAT_SQL} AS category FROM ({d.HYPOTHESIS_SQL}) h LEFT JOIN ({d.ASSET_SQL}) a ON h.asset_id = a.asset_id WHERE {{cond}}),
  {{name}} AS (SELECT 'total' AS dimension, 'all' AS item, count(*) AS incidents FROM h HAVING count(*) > 0 UNION ALL SELECT 'type', category, count(*) FROM h GROUP BY category
  UNION ALL SELECT 'sector', sector, count(*) FROM h GROUP BY sector UNION ALL SELECT 'actor', actor, count(*) FROM h WHERE actor IS NOT NULL GROUP BY actor
  UNION ALL SELECT 'technique', x, count(*) FROM (SELECT unnest(list_filter(string_split(chain_text, ','), lambda x: x <> '')) AS x FROM h) GROUP BY x)"""


def _incidents(t: Tables, where: str | None = None, sector: str | None = None) -> DataFrame:
    h = d.hypotheses(t)
    return report.in_sector(h.where(where) if where else h, d.assets(t), sector)


def _stats_sql(cond: str = "true", name: str = "s") -> str:
    return "WITH " + _STATS_SQL.format(cond=cond, name=name)


@query("A-01 J-11 F-29", _stats_sql() + " SELECT * FROM s")
def incident_statistics(t: Tables) -> DataFrame:
    return report.statistics(_incidents(t))


@query("J-11 A-02", _stats_sql("a.sector = 'REGION_1'".replace("REGION_1", "ASIA")) + " SELECT * FROM s")
def sector_statistics(t: Tables) -> DataFrame:
    return report.statistics(_incidents(t, sector="ASIA"))


@query(
    "A-16 T-06",
    _stats_sql() + " SELECT item, incidents, round(incidents * 100e0 / (SELECT incidents FROM s WHERE dimension = 'total'), 1) AS share_pct FROM s WHERE dimension = 'type' ORDER BY incidents DESC, item LIMIT 5",
)
def top_types_of_period(t: Tables) -> DataFrame:
    return report.top_shares(report.statistics(_incidents(t)))


@query("A-02 T-06", _stats_sql() + " SELECT item, incidents FROM s WHERE dimension = 'technique' ORDER BY incidents DESC, item LIMIT 5")
def top_techniques(t: Tables) -> DataFrame:
    return report.top_items(report.statistics(_incidents(t)), "technique", 5).select("item", "incidents")


_TREND_SQL = f"""WITH o AS (SELECT *, year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) IN (1996, 1997)),
 c AS (SELECT 'total' AS dimension, 'all' AS item, count(*) FILTER (y = 1997) AS now, count(*) FILTER (y = 1996) AS before FROM o
   UNION ALL SELECT 'type', o_orderpriority, count(*) FILTER (y = 1997), count(*) FILTER (y = 1996) FROM o GROUP BY o_orderpriority)
 SELECT dimension, item, now, before, now - before AS change, round((now - before) * 100e0 / before, 1) AS change_pct,
   abs((now - before) * 100e0 / before) >= CASE dimension WHEN 'total' THEN 20 ELSE 30 END AS significant FROM c"""


@query("A-16 P-32", _TREND_SQL)
def yearly_trend(t: Tables) -> DataFrame:
    o = t.orders

    def stats(year: int) -> DataFrame:
        start, end = F.lit(f"{year}-01-01").cast("timestamp_ntz"), F.lit(f"{year}-12-31 23:59:59").cast("timestamp_ntz")
        kept = report.in_period(o, "o_orderdate", start, end)
        by_type = kept.groupBy(F.lit("type").alias("dimension"), F.col("o_orderpriority").alias("item")).agg(F.count(F.lit(1)).alias("incidents"))
        return by_type.unionByName(by_type.agg(F.sum("incidents").alias("incidents")).select(F.lit("total").alias("dimension"), F.lit("all").alias("item"), "incidents"))

    return report.trend(stats(1997), stats(1996))


@query(
    "P-32",
    """SELECT doc_id, strftime(coalesce(TRY_STRPTIME(x, '%Y-%m-%d'), TRY_STRPTIME(x, '%d-%m-%Y'), TRY_STRPTIME(x, '%d/%m/%Y'), TRY_STRPTIME(x, '%Y/%m/%d')), '%Y-%m-%d') AS day FROM (
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('2024-02-', lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0')) WHEN 1 THEN concat(lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0'), '-02-2024')
      WHEN 2 THEN concat(lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0'), '/03/2024') WHEN 3 THEN concat('2024/03/', lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0')) ELSE 'soon' END AS x FROM documents)""",
)
def report_dates(t: Tables) -> DataFrame:
    day = "lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0')"
    x = F.expr(
        f"CASE doc_id % 5 WHEN 0 THEN concat('2024-02-', {day}) WHEN 1 THEN concat({day}, '-02-2024') WHEN 2 THEN concat({day}, '/03/2024') WHEN 3 THEN concat('2024/03/', {day}) ELSE 'soon' END"
    )
    return t.documents.select("doc_id", report.report_date(x).cast("string").alias("day"))


_N = "(SELECT coalesce(sum(incidents), 0) FROM s WHERE {})"
_RULE_SQL = (
    _stats_sql()
    + ", n AS (SELECT CAST(" + _N.format("dimension = 'total'") + " AS BIGINT) AS total, CAST(" + _N.format("item = 'Phishing'") + " AS BIGINT) AS ph, CAST(" + _N.format("item = 'Ransomware'")
    + " AS BIGINT) AS ra, CAST(" + _N.format("item = 'Unauthorized Access'") + " AS BIGINT) AS ua, CAST(" + _N.format("dimension = 'technique' AND item = 'T1190'") + " AS BIGINT) AS ex) "
    "SELECT 'email_training' AS rule, 'HIGH' AS priority, 'M1017' AS mitigation, ph AS incidents FROM n WHERE ph / CAST(total AS DOUBLE) > 0.3 UNION ALL SELECT 'backup_recovery', 'CRITICAL', 'M1053', ra FROM n WHERE ra > 0 "
    "UNION ALL SELECT 'multi_factor', 'HIGH', 'M1032', ua FROM n WHERE ua > 2 UNION ALL SELECT 'patch_management', 'HIGH', 'M1051', ex FROM n WHERE ex >= 3"
)


@query("A-17 T-06", _RULE_SQL)
def recommendations(t: Tables) -> DataFrame:
    return report.recommendations(report.statistics(_incidents(t)))


@query(
    "F-35 S-37",
    _stats_sql()
    + ", tot AS (SELECT max(incidents) AS n FROM s WHERE dimension = 'total') SELECT string_agg(concat('| ', item, ' | ', CAST(incidents AS STRING), ' | ', printf('%.1f', incidents * 100e0 / n), '% |'), chr(10) ORDER BY incidents DESC, item) AS body "
    "FROM s, tot WHERE dimension = 'type'",
)
def report_table(t: Tables) -> DataFrame:
    return report.markdown_table(report.statistics(_incidents(t)), "type")


@query(
    "F-35",
    _stats_sql()
    + " SELECT max(incidents) FILTER (dimension = 'total') AS total, arg_max(item, (incidents, item)) FILTER (dimension = 'type') AS top_type, max(incidents) FILTER (dimension = 'type') AS top_type_incidents, "
    "arg_max(item, (incidents, item)) FILTER (dimension = 'sector') AS top_sector, max(incidents) FILTER (dimension = 'sector') AS top_sector_incidents, "
    "round(max(incidents) FILTER (dimension = 'type') * 100e0 / max(incidents) FILTER (dimension = 'total'), 1) AS top_type_pct FROM s",
)
def report_summary(t: Tables) -> DataFrame:
    return report.summary_row(report.statistics(_incidents(t)))


@query(
    "A-03 S-20",
    f"""WITH d AS ({d.DECISION_SQL}), c AS (SELECT (SELECT count(*) FROM events) AS total_ingested, (SELECT count(*) FROM events WHERE user_id % 10 IN (4, 5, 9)) AS total_quarantined,
     (SELECT count(*) FROM events WHERE value > 80) AS total_flagged, (SELECT count(*) FROM d) AS total_decisions, (SELECT count(*) FROM d WHERE human_reviewed) AS human_reviewed,
     (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS total_corrections, (SELECT count(*) FROM documents) AS security_events)
    SELECT *, round(round((total_decisions - human_reviewed) / CAST(total_decisions AS DOUBLE), 4) * 100, 1) AS coverage_pct FROM c""",
)
def telemetry_counters(t: Tables) -> DataFrame:
    e, dec = d.events(t), d.decisions(t)
    counters = report.telemetry_counters({
        "total_ingested": (e, None),
        "total_quarantined": (e, (F.col("user_id") % 10).isin(4, 5, 9)),
        "total_flagged": (e, F.col("value") > 80),
        "total_decisions": (dec, None),
        "human_reviewed": (dec, F.col("human_reviewed")),
        "total_corrections": (t.lineitem, F.col("l_returnflag") == "R"),
        "security_events": (t.documents, None),
    })
    return report.coverage_pct(counters)


@query(
    "A-05",
    """WITH x AS (SELECT event_type, value / 500 AS s FROM events) SELECT event_type, count(*) AS total, count(*) FILTER (s >= 0.15) AS anomalous, round(count(*) FILTER (s >= 0.15) / CAST(count(*) AS DOUBLE), 4) AS anomaly_rate,
    round(avg(s), 4) AS avg_score, round(max(s), 4) AS max_score, round(min(s), 4) AS min_score FROM x GROUP BY event_type""",
)
def anomaly_statistics(t: Tables) -> DataFrame:
    from vigilframe.operators.anomaly import anomaly_stats

    x = t.events.withColumn("anomaly_score", F.col("value") / 500).withColumn("is_anomalous", F.col("anomaly_score") >= 0.15)
    return x.groupBy("event_type").agg(*anomaly_stats(x))


@query(
    "A-21 A-24",
    """SELECT user_id, CASE max(CASE WHEN value > 95 THEN 2 WHEN value > 60 THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'suspicious' ELSE 'clean' END AS severity,
    count(*) FILTER (value > 95) AS quarantined, count(*) FILTER (value > 60 AND value <= 95) AS flagged, count(*) FILTER (value <= 60) AS clean, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id""",
)
def asset_severity(t: Tables) -> DataFrame:
    q, f = F.col("value") > 95, F.col("value") > 60
    rank = F.max(F.when(q, 2).when(f, 1).otherwise(0))
    return t.events.groupBy("user_id").agg(
        F.when(rank == 2, "critical").when(rank == 1, "suspicious").otherwise("clean").alias("severity"),
        F.count_if(q).alias("quarantined"), F.count_if(f & ~q).alias("flagged"), F.count_if(~f).alias("clean"), F.count_distinct("event_type").alias("kinds"),
    )


@query(
    "F-36 S-22 S-37",
    _stats_sql()
    + ", tot AS (SELECT max(incidents) AS n FROM s WHERE dimension = 'total'), b AS (SELECT string_agg(concat('| ', item, ' | ', CAST(incidents AS STRING), ' | ', printf('%.1f', incidents * 100e0 / n), '% |'), chr(10) ORDER BY incidents DESC, item) AS body "
    "FROM s, tot WHERE dimension = 'sector') SELECT 'REPORT' AS entry_type, sha256(body) AS content_hash FROM b",
)
def report_audit_entry(t: Tables) -> DataFrame:
    body = report.markdown_table(report.statistics(_incidents(t)), "sector")
    return body.select(F.lit("REPORT").alias("entry_type"), F.sha2("body", 256).alias("content_hash"))


@query(
    "S-23 P-26",
    f"SELECT hypothesis_id, state, concat(lower(state), ',', mission_impact) AS tags FROM ({d.HYPOTHESIS_SQL})",
)
def hypothesis_memory(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "memory")
    h = d.hypotheses(t).select("hypothesis_id", "goal", "state", F.array(F.lower("state"), F.col("mission_impact")).alias("tags"))
    writers.append(h.where("hypothesis_id % 2 = 0"), path, ["state"])
    writers.append(h.where("hypothesis_id % 2 <> 0"), path, ["state"])
    return t.spark.read.parquet(path).select("hypothesis_id", "state", F.array_join("tags", ",").alias("tags"))


# -- keyed tables --------------------------------------------------------------
_DECISIONS_SQL = """SELECT l_partkey AS decision_id, arg_min(l_suppkey, s) AS hypothesis_id, arg_max(l_returnflag, s) AS status, round(arg_max(l_extendedprice, s), 2) AS risk_score, round(arg_min(l_tax, s), 4) AS blast_radius
    FROM (SELECT *, l_orderkey * 1000000 + l_suppkey * 10 + l_linenumber AS s FROM lineitem) GROUP BY l_partkey"""


def _decision_changes(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(
        "l_partkey AS decision_id", "l_suppkey AS hypothesis_id", "l_returnflag AS status", "l_extendedprice AS risk_score", "l_tax AS blast_radius",
        "l_orderkey * 1000000 + l_suppkey * 10 + l_linenumber AS seq",
    )


def _rounded_decisions(rows: DataFrame) -> DataFrame:
    return rows.select("decision_id", "hypothesis_id", "status", F.round("risk_score", 2).alias("risk_score"), F.round("blast_radius", 4).alias("blast_radius"))


@query("S-25 S-26", _DECISIONS_SQL)
def upserted_decisions(t: Tables) -> DataFrame:
    return _rounded_decisions(tables.upserted(_decision_changes(t), "decision_id", "seq", tables.DECISION_MUTABLE))


@query("S-25 S-26 S-39", _DECISIONS_SQL)
def merged_decisions(t: Tables) -> DataFrame:
    """The same upserts as three change sets into a stored table, the newest set first."""
    path, changes = scratch_path(t.spark, "decisions"), _decision_changes(t)
    for part in (2, 0, 1):
        tables.merge_into(path, changes.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == part), "decision_id", "seq", tables.DECISION_MUTABLE, buckets=8)
    return _rounded_decisions(tables.merged_rows(t.spark, path))


@query(
    "S-27 S-28",
    """WITH n AS (SELECT l_orderkey AS k, arg_min(l_suppkey, (l_partkey * 10 + l_linenumber) * 100000 + l_suppkey) AS s FROM lineitem GROUP BY l_orderkey)
    SELECT k, s FROM n WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def inserted_logs(t: Tables) -> DataFrame:
    new = t.lineitem.selectExpr("l_orderkey AS k", "l_suppkey AS s", "(l_partkey * 10 + l_linenumber) * 100000 + l_suppkey AS seq")
    existing = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    return tables.insert_ignored(existing, new, "k", "seq").select("k", "s")


@query(
    "S-30 W-07",
    f"""WITH c AS (SELECT l_orderkey AS decision_id, arg_max(l_suppkey, l_partkey * 10 + l_linenumber) AS reviewer_id, arg_max(CASE WHEN l_linenumber % 2 = 0 THEN 'MONITOR' ELSE 'ISOLATE_HOST' END, l_partkey * 10 + l_linenumber) AS new_action
      FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey), d AS ({d.DECISION_SQL})
    SELECT d.decision_id, coalesce(new_action, action_taken) AS action_taken, c.decision_id IS NOT NULL OR human_reviewed AS human_reviewed, c.reviewer_id, CASE WHEN c.decision_id IS NOT NULL THEN 'applied' ELSE status END AS status
    FROM d LEFT JOIN c ON d.decision_id = c.decision_id""",
)
def reviewed_decisions(t: Tables) -> DataFrame:
    c = t.lineitem.where("l_returnflag = 'R'").selectExpr(
        "l_orderkey AS decision_id", "l_suppkey AS reviewer_id", "'applied' AS status", "CASE WHEN l_linenumber % 2 = 0 THEN 'MONITOR' ELSE 'ISOLATE_HOST' END AS new_action",
        "l_partkey * 10 + l_linenumber AS seq",
    )
    dec = d.decisions(t).withColumn("reviewer_id", F.lit(None).cast("bigint"))
    return tables.reviewed(dec, c).select("decision_id", "action_taken", "human_reviewed", "reviewer_id", "status")


@query(
    "F-34",
    "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), user_id) AS k, event_type FROM events",
)
def merged_extra_json(t: Tables) -> DataFrame:
    e = t.events.selectExpr("event_id", "user_id AS k", "event_type", "props")
    return tables.with_extra(e, "props", "k bigint").select("event_id", "k", "event_type")


@query("T-01 T-07 R-06", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def replay_buffer(t: Tables) -> DataFrame:
    return tables.newest(t.events, [F.desc("ts"), F.desc("event_id")], 1000).select("event_id", "user_id", "event_type")


@query("T-07", "SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', text, source)), '@') OR contains(text, '192.') ORDER BY doc_id DESC LIMIT 200")
def logs_with_address(t: Tables) -> DataFrame:
    hit = tables.matches_search([F.col("text"), F.col("source")], "@") | F.col("text").contains("192.")
    return tables.newest(t.documents.where(hit), [F.desc("doc_id")], 200).select("doc_id")


@query(
    "J-19",
    """WITH pick AS (SELECT coalesce(max(CASE WHEN o_custkey = -77 THEN o_custkey END), arg_max(o_custkey, o_orderkey)) AS c FROM orders),
    x AS (SELECT o_custkey AS incident, CASE WHEN o_orderstatus = 'F' THEN 'reversed' ELSE 'taken' END AS kind, o_orderpriority AS act, o_orderkey FROM orders)
    SELECT incident, kind, act AS action, count(*) AS times, incident = (SELECT c FROM pick) AS selected FROM x GROUP BY incident, kind, act""",
)
def incident_actions(t: Tables) -> DataFrame:
    """Actions taken and reversed per incident; an unknown id selects the newest incident."""
    chosen = t.orders.agg(
        F.coalesce(F.max(F.when(F.col("o_custkey") == -77, F.col("o_custkey"))), F.max_by("o_custkey", "o_orderkey")).alias("incident")
    ).withColumn("hit", F.lit(True))
    kind = F.when(F.col("o_orderstatus") == "F", "reversed").otherwise("taken")
    counted = t.orders.groupBy(F.col("o_custkey").alias("incident"), kind.alias("kind"), F.col("o_orderpriority").alias("action")).agg(F.count(F.lit(1)).alias("times"))
    return counted.join(chosen, "incident", "left").select("incident", "kind", "action", "times", F.coalesce("hit", F.lit(False)).alias("selected"))


# -- sinks read back -----------------------------------------------------------
@query(
    "S-19 S-20 S-32",
    "SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS events, round(sum(value), 2) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1",
)
def day_partitioned_log(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "log")
    writers.append_log(t.events.select("event_id", "value", F.col("ts").alias("at")), path, F.lit("2024-01-01").cast("timestamp_ntz"))
    back = t.spark.read.parquet(path).where("dt >= DATE '2024-01-10' AND dt < DATE '2024-01-20'")
    return back.groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("total"))


@query("S-25 S-36 S-39", "SELECT o_custkey AS k, max(o_orderkey) AS latest, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 2")
def swapped_table(t: Tables) -> DataFrame:
    first, second = scratch_path(t.spark, "table"), scratch_path(t.spark, "table")
    t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("latest"), F.count(F.lit(1)).alias("n")).write.parquet(first)
    t.spark.read.parquet(first).where("n > 2").write.parquet(second)
    return t.spark.read.parquet(second)


@query("S-21 S-24", "SELECT event_id, user_id, value FROM events WHERE event_id % 5 <> 0")
def json_log_scan(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "jsonl")
    line = F.when(F.col("event_id") % 10 == 0, F.lit("")).when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id", "user_id", "value")))
    t.events.select(line.alias("value")).write.text(path)
    return readers.read_jsonl(t.spark, path, "event_id bigint, user_id bigint, value double")


@query(
    "S-02 S-04",
    "SELECT c_custkey, concat('asset-', CAST(c_nationkey AS STRING)) AS asset_id, c_mktsegment AS market_segment FROM customer",
)
def csv_event_scan(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    c = t.customer.select(
        F.col("c_custkey").alias(" C Custkey"), F.concat(F.lit("asset-"), F.col("c_nationkey").cast("string")).alias("Host"), F.col("c_mktsegment").alias("Market  Segment ")
    )
    c.write.csv(path, header=True)
    df = readers.read_csv_events(t.spark, path)
    raw = F.create_map(F.lit("host"), F.col("host"))
    return df.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), records.guess_asset(raw).alias("asset_id"), "market_segment")


@query("P-27 S-36", "SELECT doc_id FROM documents WHERE doc_id % 5 >= 2")
def unexpired_indicators(t: Tables) -> DataFrame:
    created = F.expr("CASE doc_id % 5 WHEN 0 THEN 'not a date' WHEN 1 THEN '2023-12-20T00:00:00Z' ELSE '2024-01-03T10:00:00Z' END")
    i = t.documents.select("doc_id", created.alias("created"))
    return federation.unexpired(i, F.lit("2024-01-10 00:00:00").cast("timestamp")).select("doc_id")


@query(
    "P-33",
    "SELECT doc_id, lang, n_chars, concat(CAST(doc_id AS STRING), ';', CAST(n_chars AS STRING)) AS listed, concat('{\"lang\":\"', lang, '\",\"n\":', CAST(n_chars AS STRING), '}') AS nested FROM documents",
)
def flattened_properties(t: Tables) -> DataFrame:
    props = F.struct("lang", "n_chars", F.array("doc_id", "n_chars").alias("listed"), F.struct("lang", F.col("n_chars").alias("n")).alias("nested"))
    flat = tables.flat_properties(t.documents.select("doc_id", props.alias("props")), "props")
    return flat.withColumn("listed", F.array_join("listed", ";"))


@query(
    "S-29 S-27",
    """SELECT event_id, event_type AS source, 0e0 AS trust_score, user_id % 2 = 0 AS quarantined, false AS flagged, value / 100 AS anomaly_score, event_id % 4 AS steps, length(substring(repeat('x', CAST(800 + event_id % 400 AS INT)), 1, 1000)) AS reason_chars FROM events""",
)
def ingest_event_rows(t: Tables) -> DataFrame:
    trace = F.slice(F.array(*[F.lit(f"step-{i}") for i in range(4)]), 1, (F.col("event_id") % 4).cast("int"))
    reason = F.expr("repeat('x', CAST(800 + event_id % 400 AS INT))")
    e = t.events.select(
        "event_id", F.col("event_type").alias("source"), F.lit(None).cast("double").alias("trust_score"), (F.col("user_id") % 2 == 0).alias("quarantined"),
        F.lit(None).cast("boolean").alias("flagged"), (F.col("value") / 100).alias("anomaly_score"), trace.alias("trace"), reason.alias("reason"),
    )
    cut = tables.security_log_rows(e).select("event_id", F.length("reason").cast("bigint").alias("reason_chars"))
    return tables.ingest_rows(e).join(cut, "event_id")


@query(
    "S-33",
    """SELECT event_id AS evidence_id, event_type AS source, concat('asset-', CAST(user_id AS STRING)) AS asset_id, concat('{"method":"', event_type, '","src_ip":"10.0.0.', CAST(user_id % 250 AS STRING), '"}') AS message FROM events""",
)
def log_documents(t: Tables) -> DataFrame:
    e = d.events(t).select(
        F.col("event_id").alias("evidence_id"), F.col("ts").alias("event_time"), F.col("event_type").alias("source"), "asset_id",
        F.create_map(F.lit("method"), F.col("event_type"), F.lit("src_ip"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"))).alias("normalized"),
        F.lit("").alias("content_fingerprint"),
    )
    return writers.log_document(e).select("evidence_id", "source", "asset_id", "message")


@query(
    "S-31 T-02",
    "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 3",
)
def newest_reports(t: Tables) -> DataFrame:
    """The newest reports of every hypothesis."""
    return tables.newest_per_key(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


# -- evaluation ----------------------------------------------------------------
_EVAL = {"doc_id": "doc_id", "truth": "quality = 1", "score": "CAST((doc_id * 31) % 101 AS DOUBLE) / 101 * 5e-1 + quality * 3e-1"}
_EVAL_SQL = "SELECT " + ", ".join(f"{v} AS {k}" for k, v in _EVAL.items()) + " FROM labels"


def _scored_labels(t: Tables) -> DataFrame:
    return t.labels.selectExpr(*[f"{v} AS {k}" for k, v in _EVAL.items()])


@query(
    "A-12 A-13",
    f"""WITH x AS ({_EVAL_SQL}), c AS (SELECT count(*) FILTER (truth AND score > 0.45) AS tp, count(*) FILTER (NOT truth AND score > 0.45) AS fp, count(*) FILTER (truth AND score <= 0.45) AS fn, count(*) FILTER (NOT truth AND score <= 0.45) AS tn FROM x)
    SELECT tp, fp, fn, tn, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy, round(tp / CAST(tp + fp AS DOUBLE), 6) AS precision, round(tp / CAST(tp + fn AS DOUBLE), 6) AS recall,
     round(2e0 * tp / (2 * tp + fp + fn), 6) AS f1, round(fp / CAST(fp + tn AS DOUBLE), 6) AS fpr, round(fp / CAST(fp + tn AS DOUBLE), 6) AS derived_fpr FROM c""",
)
def confusion_metrics(t: Tables) -> DataFrame:
    from vigilframe.functions.scoring import false_positive_rate

    row = evaluate.confusion(_scored_labels(t), F.col("truth"), F.col("score") > 0.45)
    n, a = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"), F.col("tp") + F.col("fn")
    row = row.withColumn("derived_fpr", false_positive_rate(F.col("precision"), F.col("recall"), n, a))
    return row.select("tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "fpr", "derived_fpr")])


@query(
    "A-14",
    f"""WITH x AS ({_EVAL_SQL}), g AS (SELECT score, count(*) FILTER (truth) AS pos, count(*) FILTER (NOT truth) AS neg FROM x GROUP BY score),
    c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g),
    r AS (SELECT score, tp / CAST(p AS DOUBLE) AS tpr, fp / CAST(n AS DOUBLE) AS fpr FROM c), auc AS (SELECT CAST(sum(neg * (tp - pos) + 5e-1 * neg * pos) AS DOUBLE) / max(p * n) AS auc FROM c)
    SELECT round(score, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(auc, 6) AS auc FROM r, auc WHERE fpr <= 0.1 ORDER BY r.tpr DESC, r.fpr, r.score DESC LIMIT 1""",
)
def roc_threshold(t: Tables) -> DataFrame:
    points = evaluate.roc_points(_scored_labels(t), F.col("score"), F.col("truth"))
    out = evaluate.roc_threshold(points, 0.1)
    return out.select(*[F.round(c, 6).alias(c) for c in ("threshold", "tpr", "fpr", "auc")])


@query(
    "A-15",
    f"WITH x AS ({_EVAL_SQL}), r AS (SELECT avg(score) FILTER (truth) AS a, avg(score) FILTER (NOT truth) AS b FROM x) SELECT round(a, 6) AS attack_mean, round(b, 6) AS benign_mean, round(a / b, 6) AS ratio, a / b >= 2 AS passed FROM r",
)
def score_separation(t: Tables) -> DataFrame:
    s = evaluate.separation(_scored_labels(t), F.col("score"), F.col("truth"), 2.0)
    return s.select(*[F.round(c, 6).alias(c) for c in ("attack_mean", "benign_mean", "ratio")], "passed")


@query(
    "A-19",
    "WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY toxic) SELECT toxic, n, round(CASE WHEN toxic = 1 THEN (SELECT max(n) FILTER (toxic = 0) FROM c) / CAST(n AS DOUBLE) ELSE 1e0 END, 6) AS weight FROM c",
)
def class_weights(t: Tables) -> DataFrame:
    return evaluate.class_weights(t.labels, "toxic").select("toxic", "n", F.round("weight", 6).alias("weight"))


@query(
    "A-27",
    """WITH x AS (SELECT *, ((vec_id * 7919) % 10007) / 10007e0 AS p FROM embeddings), r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY p, vec_id) AS rk, count(*) OVER (PARTITION BY label) AS n FROM x),
    s AS (SELECT *, greatest(1, CAST(round_even(n * 7e-1, 0) AS BIGINT)) AS nt, CASE WHEN n > 2 THEN greatest(1, CAST(round_even(n * 15e-2, 0) AS BIGINT)) ELSE 0 END AS nv FROM r)
    SELECT vec_id, label, CASE WHEN nt + nv >= n AND n >= 3 THEN CASE WHEN rk <= greatest(1, n - 2) THEN 'train' WHEN rk <= greatest(1, n - 2) + 1 THEN 'val' ELSE 'test' END
      ELSE CASE WHEN rk <= nt THEN 'train' WHEN rk <= nt + nv THEN 'val' ELSE 'test' END END AS split FROM s""",
)
def stratified_split(t: Tables) -> DataFrame:
    p = ((F.col("vec_id") * 7919) % 10007) / F.lit(10007.0)
    return evaluate.stratified_split(t.embeddings, "label", p, "vec_id").select("vec_id", "label", "split")


@query("T-08", "SELECT event_id FROM events ORDER BY ((event_id * 7919) % 1000003) / 1000003e0 LIMIT 500")
def seeded_subsample(t: Tables) -> DataFrame:
    return evaluate.subsample(t.events.select("event_id"), ((F.col("event_id") * 7919) % 1000003) / F.lit(1000003.0), 500)


@query(
    "S-14 S-15",
    "SELECT count(*) AS matched, CAST(sum(CAST(a.event_type = b.event_type AND a.value = b.value AS INT)) AS BIGINT) AS aligned FROM events a JOIN events b USING (event_id)",
)
def zipped_files(t: Tables) -> DataFrame:
    from vigilframe.sources.graphs import zipped_by_position

    # the same rows in files of different sizes: small then large on the left, the other way round on the right
    rows = t.events.select("event_id", "event_type").repartitionByRange(1, "event_id").sortWithinPartitions("event_id")
    sides = []
    for low in (100, 700):
        path = scratch_path(t.spark, "zip")
        for name, part in (("a", f"event_id < {low}"), ("b", f"event_id >= {low}")):
            rows.where(part).write.parquet(f"{path}/part={name}")
        sides.append(t.spark.read.parquet(path))
    left = sides[0].select("event_id", F.col("event_type").alias("left_type"))
    right = sides[1].select(F.col("event_id").alias("right_id"), F.col("event_type").alias("right_type"))
    z = zipped_by_position(left, right)
    return z.agg(F.count(F.lit(1)).alias("matched"), F.count_if((F.col("left_type") == F.col("right_type")) & (F.col("event_id") == F.col("right_id"))).alias("aligned"))
