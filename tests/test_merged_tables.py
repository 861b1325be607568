"""Upserts into a stored table: change sets equal one upsert, untouched buckets stay as they are."""

import glob
import os
import random

import pytest

from vigilframe.operators import tables

SCHEMA = "k string, action_taken string, created string, note string, seq long"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}


def test_change_sets_in_any_order_equal_one_upsert(spark, folder):
    rng = random.Random(3)
    seqs = rng.sample(range(10_000), 600)
    # A key with a third of all rows, nulls as values and as a key.
    rows = [(rng.choice(["hot", None] + [f"k{i}" for i in range(80)]) if rng.random() < 0.7 else "hot", rng.choice(["a", "b", None]), rng.choice("xyz"), f"n{s}", s) for s in seqs]
    path = folder + "/table"
    for i in range(3):
        tables.merge_into(path, spark.createDataFrame(rows[i::3], SCHEMA), "k", "seq", ["action_taken", "note"], buckets=8)
    want = {}
    for k, action, created, note, seq in sorted(rows, key=lambda r: r[4]):
        want[k] = (action, want[k][1] if k in want else created, note)
    got = [tuple(r) for r in tables.merged_rows(spark, path).select("k", "action_taken", "created", "note").collect()]
    assert len(got) == len(want) and {r[0]: r[1:] for r in got} == want
    once = tables.upserted(spark.createDataFrame(rows, SCHEMA), "k", "seq", ["action_taken", "note"])
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in once.select("k", "action_taken", "created", "note").collect())


def test_untouched_buckets_keep_their_files(spark, folder):
    path = folder + "/table"
    tables.merge_into(path, spark.createDataFrame([(f"k{i}", "a", "x", "n", i) for i in range(200)], SCHEMA), "k", "seq", ["action_taken"], buckets=16)
    before = files(path)
    tables.merge_into(path, spark.createDataFrame([("k7", "b", "y", "m", 900)], SCHEMA), "k", "seq", ["action_taken"], buckets=16)
    after = files(path)
    gone = {os.path.dirname(f) for f in before if f not in after}
    assert len(gone) == 1 and all(after[f] == before[f] for f in before if os.path.dirname(f) not in gone)
    assert tables.merged_rows(spark, path).count() == 200
    assert tuple(tables.merged_rows(spark, path).where("k = 'k7'").select("action_taken", "created", "note").first()) == ("b", "x", "n")
    tables.merge_into(path, spark.createDataFrame([], SCHEMA), "k", "seq", ["action_taken"], buckets=16)
    assert files(path) == after
    with pytest.raises(ValueError):
        tables.merge_into(path, spark.createDataFrame([], SCHEMA), "k", "seq", ["action_taken"], buckets=32)
