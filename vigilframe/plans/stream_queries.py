"""Queries: streaming jobs, run over the driver tables until all is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.functions import text
from vigilframe.operators import enrich
from vigilframe.plans import derived as d
from vigilframe.plans.registry import Tables, query
from vigilframe.session import scratch_path
from vigilframe.streaming import jobs


def _fed(t: Tables, job, slots: int = 3) -> None:
    """Deliver the event table in time order, one slot at a time.

    ``job`` gets the stream after each delivery and picks up from its own
    checkpoint, as a scheduled run would.
    """
    path = scratch_path(t.spark, "feed")
    events = d.events(t)
    low, high = events.agg(F.min("micros"), F.max("micros")).first()
    slot = F.least(F.lit(slots - 1), F.floor((F.col("micros") - F.lit(low)) * slots / F.lit(high - low + 1))).cast("int")
    for i in range(slots):
        events.where(slot == i).write.mode("append").parquet(path)
        job(t.spark.readStream.schema(events.schema).parquet(path))


@query(
    "R-01 S-43 P-04",
    d.trust_sql(
        "source", d.EVENT_SQL,
        "SELECT CASE WHEN trust_score = 0 THEN 'held' ELSE 'passed' END AS outcome, source, count(*) AS events, round(max(trust_score), 4) AS trust_score FROM scored GROUP BY 1, 2",
    ),
)
def streaming_ingest(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "ingest")
    raw = F.create_map(F.lit("source"), F.col("source"), F.lit("msg"), F.col("event_type"))
    _fed(t, lambda e: jobs.ingest_stream(e.select("event_id", raw.alias("raw")), f"{base}/passed", f"{base}/held", f"{base}/checkpoint"))
    both = None
    for name in ("passed", "held"):
        part = t.spark.read.parquet(f"{base}/{name}").select(F.lit(name).alias("outcome"), "source", "trust_score")
        both = part if both is None else both.unionByName(part)
    return both.groupBy("outcome", "source").agg(F.count(F.lit(1)).alias("events"), F.round(F.max("trust_score"), 4).alias("trust_score"))


@query(
    "R-01 P-06 F-02",
    d.trust_sql("source", d.EVENT_SQL, "SELECT event_id, concat('10.0.0.', CAST(user_id % 200 AS STRING)) AS src_ip, event_type AS seen FROM scored WHERE trust_score > 0"),
)
def streaming_normalized(t: Tables) -> DataFrame:
    """Rows that pass are normalised within the stream; the address is found in the text."""
    base = scratch_path(t.spark, "normalized")
    note = F.concat(F.lit("conn from 10.0.0."), (F.col("user_id") % 200).cast("string"), F.lit(" again"))
    raw = F.create_map(F.lit("source"), F.col("source"), F.lit("note"), note).alias("raw")
    _fed(
        t,
        lambda e: jobs.ingest_stream(
            e.select("event_id", F.col("event_type").alias("seen"), raw), f"{base}/passed", f"{base}/held", f"{base}/checkpoint", enrich.normalized
        ),
    )
    return t.spark.read.parquet(f"{base}/passed").select("event_id", F.col("normalized")["src_ip"].alias("src_ip"), "seen")


@query(
    "R-02 R-08 W-01",
    """WITH w AS (SELECT event_id, value, count(*) OVER o AS n, avg(value) OVER o AS m, var_samp(value) OVER o AS v FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT event_id, n, round(CASE WHEN n < 10 THEN 0e0 ELSE 1 - exp(-abs(value - m) / sqrt(greatest(v, 1e-8)) / 3) END, 5) AS temporal_score FROM w""",
)
def streaming_baseline(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "baseline")
    _fed(
        t,
        lambda e: jobs.baseline_stream(
            e.select("event_id", "user_id", "micros", "value"), "user_id", "micros", "event_id", ["value"],
            f"{base}/out", f"{base}/checkpoint",
        ),
    )
    return t.spark.read.parquet(f"{base}/out").where("not late").select("event_id", F.col("n").cast("bigint").alias("n"), F.round("temporal_score", 5).alias("temporal_score"))


@query(
    "R-03 W-02",
    """WITH w AS (SELECT event_id, concat('A', CAST(user_id % 4 AS STRING)) AS agent_id, count(*) OVER (PARTITION BY user_id % 4 ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS calls FROM events)
    SELECT event_id, agent_id, calls FROM w WHERE calls > 5""",
)
def streaming_rate_alarms(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "rate")
    agent = F.concat(F.lit("A"), (F.col("user_id") % 4).cast("string")).alias("agent_id")
    limits = d.events(t).select(agent).distinct().withColumn("max_calls_per_minute", F.lit(5))
    _fed(
        t,
        lambda e: jobs.rate_stream(
            e.select("event_id", agent, "micros"), limits, "micros", 3600, f"{base}/out", f"{base}/checkpoint"
        ),
    )
    return t.spark.read.parquet(f"{base}/out").where("not late").select("event_id", "agent_id", "calls")


@query(
    "R-04 F-06",
    "SELECT DISTINCT sha256(concat(event_type, '|', CAST(user_id AS STRING))) AS fingerprint FROM events",
)
def streaming_first_seen(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "seen")
    fp = F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string")), 256)
    _fed(
        t,
        lambda e: jobs.first_seen_stream(
            e.select(fp.alias("fingerprint"), F.col("ts").cast("timestamp").alias("seen_at")), "fingerprint", "seen_at", "60 days",
            f"{base}/out", f"{base}/checkpoint",
        ),
    )
    return t.spark.read.parquet(f"{base}/out").select("fingerprint")


@query(
    "R-05 J-08",
    """WITH i AS (SELECT doc_id % 120 AS v, count(*) AS n FROM documents WHERE doc_id % 5 >= 2 GROUP BY 1)
    SELECT event_id, n AS matches FROM events JOIN i ON event_id % 200 = v""",
)
def streaming_indicator_matches(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "ioc")
    indicators = t.documents.select(
        F.format_string("[ipv4-addr:value = '203.0.113.%d']", F.col("doc_id") % 120).alias("pattern"),
        F.expr("CASE doc_id % 5 WHEN 0 THEN 'not a date' WHEN 1 THEN '2023-12-20T00:00:00Z' ELSE '2024-01-03T10:00:00Z' END").alias("created"),
    )
    beacon = F.concat(F.lit("beacon 203.0.113."), (F.col("event_id") % 200).cast("string")).alias("text")
    now = F.lit("2024-01-10").cast("timestamp")
    _fed(
        t,
        lambda e: jobs.matched_stream(
            e.select("event_id", beacon), text.public_ips(F.col("text")), indicators, now, f"{base}/out", f"{base}/checkpoint"
        ),
    )
    return t.spark.read.parquet(f"{base}/out").select("event_id", "matches")


@query(
    "R-05 S-42",
    """WITH e AS (SELECT user_id % 40 AS v, ts AS said_at, max(event_id % 7) AS m FROM events WHERE event_id % 5 = 0 GROUP BY ALL),
    a AS (SELECT event_id, said_at, s.ts, m FROM (SELECT event_id, user_id % 40 AS v, ts FROM events WHERE event_id % 5 <> 0) s ASOF LEFT JOIN e ON s.v = e.v AND s.ts >= e.said_at)
    SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(said_at) <= 86400000000 THEN round(m / 10e0 + CASE WHEN m = 6 THEN 5e-2 ELSE 0e0 END, 5) ELSE 0e0 END AS hunt_score FROM a""",
)
def streaming_reputation(t: Tables) -> DataFrame:
    """Every fifth event brings a reputation of its value, which counts for a day; the others are sightings."""
    base = scratch_path(t.spark, "reputation")
    m = F.col("event_id") % 7
    said = F.struct(
        m.cast("int").alias("malicious"), F.lit(0).alias("suspicious"), (F.lit(10) - m).cast("int").alias("undetected"), F.lit(0).alias("harmless"),
        F.array().cast("array<string>").alias("vulns"), F.when(m == 6, F.array(F.lit("C2"))).otherwise(F.array().cast("array<string>")).alias("tags"),
    )
    rows = [
        "event_id", F.lit("ip").alias("type"), F.concat(F.lit("203.0.113."), (F.col("user_id") % 40).cast("string")).alias("value"), "micros",
        F.when(F.col("event_id") % 5 == 0, said).alias("reputation"),
    ]
    _fed(t, lambda e: jobs.reputation_stream(e.select(*rows), "micros", f"{base}/out", f"{base}/checkpoint"))
    return t.spark.read.parquet(f"{base}/out").where("not late").select("event_id", F.round("hunt_score", 5).alias("hunt_score"))


@query("R-07 A-03", "SELECT event_type, count(*) AS events, count(*) FILTER (value > 80) AS flagged FROM events GROUP BY event_type")
def streaming_counters(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "counters")
    counters = {"events": F.count(F.lit(1)), "flagged": F.count_if(F.col("value") > 80)}
    _fed(t, lambda e: jobs.counter_stream(e, ["event_type"], counters, f"{base}/out", f"{base}/checkpoint"))
    return jobs.latest_counters(t.spark, f"{base}/out", ["event_type"])


@query(
    "R-08 R-02",
    """WITH s AS (SELECT *, least(2, CAST(floor((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events)) * 3 / ((SELECT max(epoch_us(ts)) - min(epoch_us(ts)) + 1 FROM events))) AS INT)) AS slot FROM events),
    f AS (SELECT *, CASE WHEN slot < 2 AND event_id % 10 = 0 THEN slot + 1 ELSE slot END AS fed FROM s),
    m AS (SELECT fed, max(epoch_us(ts)) AS newest FROM f GROUP BY fed)
    SELECT event_id, coalesce(epoch_us(ts) < (SELECT max(newest) FROM m WHERE m.fed < f.fed), false) AS late FROM f""",
)
def streaming_late_rows(t: Tables) -> DataFrame:
    """A tenth of the rows arrives one delivery late: each row is scored or kept as a late one."""
    base = scratch_path(t.spark, "late")
    path = scratch_path(t.spark, "feed")
    events = d.events(t).select("event_id", "user_id", "micros", "value")
    low, high = events.agg(F.min("micros"), F.max("micros")).first()
    slot = F.least(F.lit(2), F.floor((F.col("micros") - F.lit(low)) * 3 / F.lit(high - low + 1))).cast("int")
    fed = F.when((slot < 2) & (F.col("event_id") % 10 == 0), slot + 1).otherwise(slot)
    for i in range(3):
        events.where(fed == i).write.mode("append").parquet(path)
        jobs.baseline_stream(
            t.spark.readStream.schema(events.schema).parquet(path), "user_id", "micros", "event_id", ["value"],
            f"{base}/out", f"{base}/checkpoint",
        )
    return t.spark.read.parquet(f"{base}/out").select("event_id", "late")
