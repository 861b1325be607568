import pytest
from pyspark.sql import functions as F

from test_windows import rows, twin_baseline
from vigilframe.streaming import jobs


def feed(spark, folder, parts, schema):
    """Deliver the parts one by one; yields the stream after each delivery."""
    for part in parts:
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(folder + "/feed")
        yield spark.readStream.schema(schema).parquet(folder + "/feed")


def test_baseline_stream_equals_batch_and_sets_late_rows_aside(spark, folder):
    data = sorted(rows(400, 9), key=lambda r: (r[2], r[1]))
    late = [("hot", 9999, 0, 1.0)]
    schema = "asset string, i bigint, micros bigint, v double"
    for stream in feed(spark, folder, [data[:150], data[150:300], data[300:] + late], schema):
        jobs.baseline_stream(stream, "asset", "micros", "i", ["v"], folder + "/out", folder + "/cp")
    got = {r["i"]: r["temporal_score"] for r in spark.read.parquet(folder + "/out").where("not late").collect()}
    want = twin_baseline(data)
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-6
    assert [(r["i"], r["temporal_score"]) for r in spark.read.parquet(folder + "/out").where("late").collect()] == [(9999, None)]


def test_rate_stream_sees_calls_of_the_batch_before(spark, folder):
    schema = "call_id bigint, agent_id string, micros bigint"
    calls = [(i, "A", i * 10_000_000) for i in range(20)]
    limits = spark.createDataFrame([("A", 6)], "agent_id string, max_calls_per_minute int")
    for stream in feed(spark, folder, [calls[:5], calls[5:9], calls[9:]], schema):
        jobs.rate_stream(stream, limits, "micros", 60, folder + "/out", folder + "/cp")
    got = {r["call_id"]: r["calls"] for r in spark.read.parquet(folder + "/out").collect()}
    assert got == {i: 7 for i in range(6, 20)}


def test_repeated_batch_overwrites_itself(spark, folder):
    df = spark.range(4)
    jobs.write_batch(df, folder + "/o", 3)
    jobs.write_batch(df, folder + "/o", 3)
    assert spark.read.parquet(folder + "/o").count() == 4


def test_duplicates_and_windows(spark, folder):
    schema = "k string, at timestamp"
    at = lambda s: __import__("datetime").datetime.fromisoformat(s)
    parts = [[("x", at("2024-01-01T00:00:00")), ("x", at("2024-01-01T00:00:10")), ("y", at("2024-01-01T00:01:00"))], [("x", at("2024-01-01T00:02:00")), ("z", at("2024-01-01T01:00:00"))]]
    for stream in feed(spark, folder, parts, schema):
        jobs.first_seen_stream(stream, "k", "at", "1 day", folder + "/seen", folder + "/cp1")
        jobs.windowed_rates(stream, "k", "at", "1 minute", "60 seconds", "60 seconds", folder + "/rates", folder + "/cp2")
    assert sorted(r["k"] for r in spark.read.parquet(folder + "/seen").collect()) == ["x", "y", "z"]
    rates = {(r["k"], str(r["start"])): r["calls"] for r in spark.read.parquet(folder + "/rates").collect()}
    assert rates[("x", "2024-01-01 00:00:00")] == 2 and rates[("x", "2024-01-01 00:02:00")] == 1


@pytest.mark.parametrize("column", ["passed", "held"])
def test_ingest_stream_conserves_rows(spark, folder, column):
    schema = "i int, raw map<string,string>"
    parts = [[(1, {"source": "CERT-In", "m": "../x"}), (2, {"source": "xyzzy"})], [(3, {"m": "none"})]]
    for stream in feed(spark, folder, parts, schema):
        jobs.ingest_stream(stream, folder + "/passed", folder + "/held", folder + "/cp")
    ids = {r["i"] for r in spark.read.parquet(f"{folder}/{column}").collect()}
    assert ids == ({1} if column == "passed" else {2, 3})
