import random
import datetime as dt

import pytest
from pyspark.sql import functions as F

from vigilframe.functions import records
from vigilframe.operators import enrich, ingest


def maps(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw map<string,string>")


@pytest.mark.parametrize(
    "label, score",
    [
        ("CERT-In", 0.95), ("cert_in advisory", 0.95), ("internal", 0.70), ("partner", 0.50), ("Crowd Strike", 0.75),
        ("vendor-crowdstrike", 0.75), ("ui-manual", 0.85), ("xyzzy", 0.0), ("", 0.0), (" - _ ", 0.0), ("n", 0.95),
    ],
)
def test_trust(spark, label, score):
    df = ingest.with_trust(spark.createDataFrame([(label,)], "source string"))
    assert df.first()["trust_score"] == score


def test_split_conserves_rows(spark):
    df = spark.createDataFrame([("CERT-In",), ("nobody77",), ("test",)], "source string")
    passed, held = ingest.trust_split(ingest.with_trust(df))
    assert passed.count() == 2 and held.count() == 1 and held.first()["reason"].endswith("0.00")


def test_ingest_is_one_narrow_stage(spark):
    df = maps(spark, {"source": "CERT-In", "msg": "../modbus"})
    out = ingest.ingest(df)
    row = out.first()
    assert row["protocol"] == "Modbus" and row["sanitized"]["msg"] == "[SANITIZED:PATH_TRAVERSAL]modbus"
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_source_types(spark):
    rows = [
        ({"Flow ID": "1", "EventID": "2"}, "cicids_2017"), ({"EventID": "2"}, "windows_event"), ({"dst_addr": "x"}, "netflow"),
        ({"function": "f", "register": "r"}, "scada"), ({"function": "f"}, "generic"), ({"request_path": "/"}, "web_access_log"),
    ]
    got = maps(spark, *[r for r, _ in rows]).orderBy("i").select(records.source_type(F.col("raw")).alias("t")).collect()
    assert [g["t"] for g in got] == [w for _, w in rows]


def test_mapping_then_direct_pass(spark):
    out = enrich.normalized(maps(spark, {"src_addr": "1.1.1.1", "proto": "tcp", "path": "/direct", "pkts": "4"})).first()
    assert out["normalized"] == {"src_ip": "1.1.1.1", "protocol": "tcp", "path": "/direct", "packets": "4"}


def test_missing_address_is_taken_from_the_text(spark):
    out = enrich.normalized(maps(spark, {"msg": "user=eve from 5.6.7.8"})).first()
    assert out["normalized"]["src_ip"] == "5.6.7.8" and out["entities"]["user"] == "eve"


@pytest.mark.parametrize(
    "text_, wanted",
    [
        ("2024-01-05T06:07:08Z", "2024-01-05 06:07:08"), ("2024-01-05 06:07:08", "2024-01-05 06:07:08"),
        ("05/Jan/2024:06:07:08 +0000", "2024-01-05 06:07:08"), ("1704434828", "2024-01-05 06:07:08"), ("soon", "2000-01-01 00:00:00"),
    ],
)
def test_event_time(spark, text_, wanted):
    df = maps(spark, {"timestamp": text_})
    got = df.select(records.event_time(F.col("raw"), F.lit("2000-01-01").cast("timestamp")).cast("string")).first()[0]
    assert got == wanted


def test_malformed_audit_time(spark):
    df = spark.createDataFrame([("2026-07-01T10:00:00.5+00:00Z",), ("2026-07-01T10:00:00Z",)], "t string")
    got = [r[0] for r in df.select(records.audit_time(F.col("t")).cast("string")).collect()]
    assert got == ["2026-07-01 10:00:00.5", "2026-07-01 10:00:00"]


def test_calendar(spark):
    rows = [dt.datetime(2024, 3, 22), dt.datetime(2024, 8, 15, 20), dt.datetime(2024, 6, 4), dt.datetime(2024, 6, 4, 1), dt.datetime(2023, 4, 20, 9)]
    df = spark.createDataFrame([(r,) for r in rows], "ts timestamp")
    got = df.select(records.calendar_flags(F.col("ts")).alias("f"), records.time_of_day(F.col("ts")).alias("t")).collect()
    assert got[0]["f"].asDict() == {"exam_season": True, "govt_year_end": True, "election_period": False, "holiday_period": False}
    assert got[1]["f"]["holiday_period"] and got[1]["t"] == "off_hours"
    assert got[2]["f"]["election_period"] and not got[3]["f"]["election_period"]
    assert got[4]["t"] == "business_hours" and got[0]["t"] == "night"


@pytest.mark.parametrize(
    "chain, category",
    [
        (["T1566"], "Phishing"), (["T1486", "T1003"], "Ransomware"), (["T1499"], "DDoS"), (["T1078"], "Unauthorized Access"),
        (["T1190", "T1059"], "Vulnerability Exploitation"), (["T1204"], "Malicious Code"), (["T1595"], "Network Scanning"), (["T1"], "Other"), ([], "Unknown"), (None, "Unknown"),
    ],
)
def test_categories(spark, chain, category):
    df = spark.createDataFrame([(chain,)], "c array<string>")
    assert df.select(records.technique_category(F.col("c"))).first()[0] == category


def test_deadline_is_clamped(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    at = lambda s: df.select(records.deadline_seconds(F.col("t"), F.lit(s).cast("timestamp"))).first()[0]
    assert (at("2023-12-31 00:00:00"), at("2024-01-01 05:00:00"), at("2024-01-02 00:00:00")) == (21600, 3600, 0)


def test_embedding_expansion_and_validation(spark):
    df = spark.createDataFrame([("a" * 64, [0.0], 0.5, 0.5), ("zz", [1.0, 2.0], 1.5, None)], "content_fingerprint string, behavior_embedding array<float>, confidence double, uncertainty double")
    df = df.withColumn("behavior_embedding", records.expand_embedding(F.col("behavior_embedding"), 256))
    good, bad = ingest.validated(df, ingest.evidence_checks())
    assert good.count() == 1
    assert bad.first()["failed_checks"] == ["content_fingerprint", "behavior_embedding", "confidence", "uncertainty"]


def test_asset_by_id_by_address_and_default(spark):
    cols = "asset_id string, ip string, criticality string, mission string, type string, safety_critical boolean, can_reboot boolean, can_interrupt boolean, impact_if_compromised string"
    assets = spark.createDataFrame([("web", "10.0.0.1", "HIGH", "exam_portal", "web_server", False, True, True, "HIGH")], cols)
    df = spark.createDataFrame([("web",), ("10.0.0.1",), ("ghost",)], "asset_id string")
    got = {r["asset_id"]: r for r in enrich.with_asset(df, assets).collect()}
    assert got["web"]["criticality"] == got["10.0.0.1"]["criticality"] == "HIGH"
    assert got["ghost"]["criticality"] == "MEDIUM" and got["ghost"]["can_reboot"] and not got["ghost"]["asset_known"]


def test_goal_cover_matches_nested_loop(spark):
    keys = ["asset-1", "asset-12", "Web", "none", "db"]
    goals = ["check ASSET-12 now", "the dB of webs", "x"]
    got = {r[0] for r in enrich.uncovered_by_goals(spark.createDataFrame([(k,) for k in keys], "k string"), "k", spark.createDataFrame([(g,) for g in goals], "g string"), "g").collect()}
    want = {k for k in keys if not any(k.lower() in g.lower() for g in goals)}
    assert got == want


def test_goal_cover_of_keys_of_any_length(spark):
    rng = random.Random(4)
    letters = "ab\u00c9-1"
    goals = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 700))) for _ in range(40)] + [None, "", "ab"]
    keys = ["".join(rng.choice(letters) for _ in range(n)) for n in range(0, 330)]  # more lengths than any list of lengths would hold
    for g in goals[:30]:
        if g and len(g) > 4:
            at = rng.randrange(len(g) - 3)
            keys.append(g[at : at + rng.randrange(1, 400)].swapcase())
    rows = [(k,) for k in keys] + [(None,), (keys[5],)]
    got = enrich.uncovered_by_goals(spark.createDataFrame(rows, "k string"), "k", spark.createDataFrame([(g,) for g in goals], "g string"), "g").collect()
    want = [k for (k,) in rows if k is None or not any(k.lower() in g.lower() for g in goals if g is not None)]
    assert sorted(str(r[0]) for r in got) == sorted(map(str, want)) and 100 < len(want) < len(rows) - 20
    none = spark.createDataFrame([], "g string")
    assert enrich.uncovered_by_goals(spark.createDataFrame([("",), ("abc",)], "k string"), "k", none, "g").count() == 2


def test_texts_that_several_patterns_read_are_built_once(spark):
    out = enrich.normalized(maps(spark, {"start": " 3723 ", "msg": "user=eve from 5.6.7.8"}), as_of=F.lit("2000-01-01").cast("timestamp"))
    assert "_time_text" not in out.columns and "_values_text" not in out.columns
    row = out.select(F.col("event_time").cast("string").alias("at"), "entities.user").first()
    assert tuple(row) == ("1970-01-01 01:02:03", "eve")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_values(") == 1 and plan.count("TimeCreated)") <= 2
