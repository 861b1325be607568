"""Plans and data placement under skew."""

import pytest
from pyspark.sql import functions as F

from vigilframe.operators import anomaly, audit, graph, running, tables
from vigilframe.session import shared_dir, spread


@pytest.fixture()
def no_small_data_shortcuts(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def hot(spark, n=4000):
    """Half of all rows belong to one key."""
    key = F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 37).cast("string")))
    return spark.range(n).select(key.alias("asset"), "id", (F.col("id") * 60_000_000).alias("micros"), F.sin(F.col("id")).alias("v"))


def tasks_of(df, key):
    placed = df.withColumn("_task", F.spark_partition_id()).where(F.col("asset") == key)
    return placed.select("_task").distinct().count()


def test_hot_key_rows_are_in_many_tasks(spark, no_small_data_shortcuts):
    scored = anomaly.temporal_baseline(hot(spark), "asset", "micros", "id", ["v"], bucket_seconds=3600)
    assert scored.count() == 4000 and tasks_of(scored, "hot") >= 4
    placed = running.row_positions(hot(spark), ["asset"], [F.col("id")], F.floor(F.col("id") / 100))
    assert tasks_of(placed, "hot") >= 4 and placed.where("asset = 'hot'").agg(F.max("seq")).first()[0] == 2000


def test_chain_segments_are_in_many_tasks(spark, no_small_data_shortcuts):
    log = audit.chained(hot(spark), "asset", [F.col("id")], F.floor(F.col("id") / 100), ["id"])
    assert tasks_of(log, "hot") >= 4 and audit.chain_report(log, "asset").where("NOT valid").count() == 0


def test_top_k_is_limited_before_the_shuffle(spark):
    plan = tables.newest_per_key(hot(spark), ["asset"], [F.desc("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    e = hot(spark).select(F.col("asset").alias("src"), F.col("id").cast("string").alias("dst"))
    assert "WindowGroupLimit" in graph.sampled_neighbours(e)._jdf.queryExecution().executedPlan().toString()


def test_latest_and_upsert_combine_map_side(spark):
    for df in (tables.latest(hot(spark), ["asset"], F.col("id")), tables.upserted(hot(spark), "asset", "id", ["v"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "partial_m" in plan and "Window" not in plan


def test_spread_only_widens_narrow_inputs(spark):
    assert spread(spark.range(100, numPartitions=1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(100, numPartitions=50)
    assert spread(wide, "id") is wide


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark).startswith(("file:" + named, named))


def test_flagship_plan_prunes_columns_and_stays_in_the_jvm(spark):
    from conftest import SF
    from vigilframe import plans
    from vigilframe.plans.registry import REGISTRY

    plans.load_all()
    plan = REGISTRY["telemetry_screening"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "props" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_ranges_split_a_hot_key_and_a_hot_day(spark, monkeypatch):
    """With defaults, neither one key nor one instant's day puts more than a range of rows into a bucket."""
    monkeypatch.setattr(running, "RANGE_ROWS", 500)
    rows = hot(spark)
    dealt, bucket = running.ranged(rows, ["asset"], [F.col("micros"), F.col("id")])
    assert dealt.groupBy(bucket.alias("b")).count().agg(F.max("count")).first()[0] < 1500
    plain = anomaly.temporal_baseline(rows, "asset", "micros", "id", ["v"], bucket_seconds=3600).select("id", "n", F.round("temporal_score", 6).alias("s"))
    split = anomaly.temporal_baseline(rows, "asset", "micros", "id", ["v"]).select("id", "n", F.round("temporal_score", 6).alias("s"))
    assert plain.exceptAll(split).count() == 0
    seqs = running.sliding_sequences(rows, [F.col("id")], None, F.col("id"), 10)
    assert seqs.count() == rows.count() - 9 and seqs.where("sequence[9] - sequence[0] <> 9").count() == 0
