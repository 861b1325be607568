"""Keyed state of the streams: late rows, restarts, repeated micro-batches and what the state store holds."""

import random

import pytest
from test_streaming import feed
from test_windows import rows, twin_baseline

from vigilframe.streaming import jobs

CALLS = "call_id bigint, agent_id string, micros bigint"
SECOND = 1_000_000


def arrivals(seed, lateness):
    """Deliveries of calls of a hot agent and others, some too late, some late within what is allowed."""
    rng, out, i = random.Random(seed), [], 0
    for slot in range(4):
        part = []
        for _ in range(60):
            at = slot * 100 * SECOND + rng.randrange(100 * SECOND)
            if slot and rng.random() < 0.3:
                at -= rng.randrange(1, 2 * lateness + 30) * SECOND
            part.append((i, "hot" if rng.random() < 0.6 else f"a{rng.randrange(3)}", at - at % 500_000))
            i += 1
        out.append(part)
    return out


def twin_rates(deliveries, seconds, lateness):
    """{call_id: calls, or None for a late call}; a call counts what has arrived by the end of its delivery."""
    out, known, newest = {}, [], None
    for part in deliveries:
        late = {c[0] for c in part if newest is not None and c[2] < newest - lateness * SECOND}
        known += [c for c in part if c[0] not in late]
        for call, agent, at in part:
            out[call] = None if call in late else sum(a == agent and at - seconds * SECOND <= t <= at for _, a, t in known)
        newest = max([c[2] for c in part] + [newest or 0])
    return out


@pytest.mark.parametrize("lateness", [0, 40])
def test_rates_with_late_calls_equal_the_twin(spark, folder, lateness):
    deliveries = arrivals(lateness, lateness or 20)
    limits = spark.createDataFrame([("hot", 0)] + [(f"a{i}", 0) for i in range(3)], "agent_id string, max_calls_per_minute int")
    for stream in feed(spark, folder, deliveries, CALLS):
        jobs.rate_stream(stream, limits, "micros", 60, folder + "/out", folder + "/cp", lateness)
    got = {r["call_id"]: (None if r["late"] else r["calls"]) for r in spark.read.parquet(folder + "/out").collect()}
    want = twin_rates(deliveries, 60, lateness)
    assert got == want and None in want.values()
    # Instants out of reach of any call that is not late have left the store.
    newest = max(c[2] for part in deliveries for c in part)
    held = spark.read.format("statestore").option("path", folder + "/cp").option("stateVarName", "instants").load()
    at = [r[0] for r in held.select("key.agent_id", "user_map_key.at").select("at").collect()]
    assert at and min(at) >= newest - (lateness + 60) * SECOND


def test_quiet_agents_leave_the_store(spark, folder):
    limits = spark.createDataFrame([("A", 1)], "agent_id string, max_calls_per_minute int")
    parts = [[(1, "A", 5 * SECOND), (2, "B", 6 * SECOND)], [(3, "B", 500 * SECOND)], [(4, "B", 501 * SECOND)]]
    for stream in feed(spark, folder, parts, CALLS):
        jobs.rate_stream(stream, limits, "micros", 60, folder + "/out", folder + "/cp")
    held = spark.read.format("statestore").option("path", folder + "/cp").option("stateVarName", "instants").load()
    assert {r[0] for r in held.select("key.agent_id").collect()} == {"B"}


def test_a_repeated_micro_batch_and_a_restart_change_nothing(spark, folder, monkeypatch):
    data = sorted(rows(300, 4), key=lambda r: (r[2], r[1]))
    schema, write, failed = "asset string, i bigint, micros bigint, v double", jobs.write_batch, []

    def failing(df, path, batch_id):
        write(df, path, batch_id)
        if len(failed) < 2:
            failed.append(batch_id)
            raise RuntimeError("lost after the output was written")

    for k, stream in enumerate(feed(spark, folder, [data[:100], data[100:200], data[200:]], schema)):
        monkeypatch.setattr(jobs, "write_batch", failing if k != 1 else write)
        while True:
            try:
                jobs.baseline_stream(stream, "asset", "micros", "i", ["v"], folder + "/out", folder + "/cp")
                break
            except Exception as error:
                assert "lost after the output was written" in str(error)
    assert len(failed) == 2
    got = {r["i"]: r["temporal_score"] for r in spark.read.parquet(folder + "/out").collect()}
    want = twin_baseline(data)
    assert len(got) == len(want) == spark.read.parquet(folder + "/out").count()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_a_micro_batch_writes_only_the_keys_it_changes(spark, folder):
    schema = "asset string, i bigint, micros bigint, v double"
    parts = [[(f"a{k}", k, k, 1.0) for k in range(400)], [("a7", 1000, 1000, 3.0)], [("a7", 1001, 1001, 5.0)]]
    written = []
    for stream in feed(spark, folder, parts, schema):
        states = []
        spark_stream = jobs.stateful.clocked(stream, "micros", 0).groupBy("asset").transformWithStateInPandas(
            jobs.stateful.Baseline("micros", "i", ["v"]), jobs.stateful.schema_with(stream, "late boolean, n double, mean_v double, var_v double"), "Append", "EventTime"
        )
        q = spark_stream.writeStream.foreachBatch(lambda b, i: states.extend(b.collect())).option("checkpointLocation", folder + "/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        written.append(sum(s["numRowsUpdated"] for p in q.recentProgress for s in p["stateOperators"]))
        last = {r["asset"]: (r["n"], r["mean_v"]) for r in states}
    assert written[0] >= 400 and max(written[1:]) < 10 and last == {"a7": (3.0, 3.0)}


SAID = "i bigint, type string, value string, micros bigint, reputation struct<malicious: int, suspicious: int, undetected: int, harmless: int, vulns: array<string>, tags: array<string>>"
HOUR = 3600 * SECOND


@pytest.mark.parametrize("lateness", [0, 3])
def test_reputation_expires_by_its_own_instant(spark, folder, lateness):
    """A hot value and others, over four days within one run; some rows come late."""
    rng, parts, i = random.Random(lateness), [], 0
    for day in range(4):
        part = []
        for _ in range(70):
            at = (1 + day * 24 + rng.randrange(24)) * HOUR
            if day and rng.random() < 0.2:
                at -= rng.randrange(1, 12) * HOUR
            value = "hot" if rng.random() < 0.5 else f"v{rng.randrange(12)}"
            part.append((i, "ip", value, at, (rng.randrange(1, 9), 0, 10, 0, [], ["C2"] * rng.randrange(2)) if rng.random() < 0.15 else None))
            i += 1
        parts.append(part)
    for stream in feed(spark, folder, parts, SAID):
        jobs.reputation_stream(stream, "micros", folder + "/out", folder + "/cp", 24, lateness * 3600)
    got = {r["i"]: (r["late"], r["reputation"] and r["reputation"]["malicious"], r["hunt_score"]) for r in spark.read.parquet(folder + "/out").collect()}
    want, known, newest = {}, [], None
    for part in parts:
        mark = None if newest is None else newest - lateness * HOUR
        known += [r for r in part if r[4]]
        for n, _, value, at, said in part:
            if said:
                continue
            late = mark is not None and at < mark
            near = [r for r in known if r[2] == value and at - 24 * HOUR <= r[3] <= at]
            last = max((r[3] for r in near), default=None)
            want[n] = (late, None if late or last is None else [r[4] for r in near if r[3] == last])
        newest = max([r[3] for r in part] + [newest or 0])
    assert set(got) == set(want) and any(w[0] for w in want.values()) and any(w[1] for w in want.values())
    for n, (late, said) in want.items():
        assert got[n][0] == late
        scores = {round(m / (m + 10), 4) + (0.05 if tags else 0) for m, _, _, _, _, tags in said or []} or {0.0}
        assert any(abs(got[n][2] - s) < 1e-9 for s in scores) and (got[n][1] is None) == (not said)
    held = spark.read.format("statestore").option("path", folder + "/cp").option("stateVarName", "said").load()
    at = [r[0] for r in held.select("user_map_key.at").collect()]
    assert at and min(at) >= newest - (24 + lateness) * HOUR
