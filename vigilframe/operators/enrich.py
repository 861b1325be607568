"""Enrichment joins and normalisation of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe import params
from vigilframe.functions import records, text
from vigilframe.session import small_side

ASSET_COLUMNS = [
    "criticality", "mission", "type", "safety_critical", "can_reboot", "can_interrupt", "impact_if_compromised",
]


def _one_per_ip(assets: DataFrame) -> DataFrame:
    """The inventory keyed by address; a shared address keeps its first asset."""
    names = [c for c in assets.columns if c != "ip"]
    return assets.where("ip IS NOT NULL").groupBy("ip").agg(*[F.min_by(F.col(c), "asset_id").alias(c) for c in names])


def with_asset(df: DataFrame, assets: DataFrame, key: str = "asset_id") -> DataFrame:
    """Add the asset columns: by id, else by address, else the defaults.

    Also adds ``asset_known``. Both lookups are equi joins; the inventory is
    broadcast only while its estimated size is small.
    """
    cols = [c for c in ASSET_COLUMNS if c in assets.columns]
    by_id = small_side(assets.select(F.col("asset_id").alias("_id"), F.struct(*cols).alias("_by_id")))
    out = df.join(by_id, F.col(key) == F.col("_id"), "left")
    found = F.col("_by_id")
    if "ip" in assets.columns:
        by_ip = _one_per_ip(assets).select(F.col("ip").alias("_ip"), F.struct(*cols).alias("_by_ip"))
        out = out.join(small_side(by_ip), F.col(key) == F.col("_ip"), "left")
        found = F.coalesce(F.col("_by_id"), F.col("_by_ip"))
    out = out.withColumn("_asset", found).withColumn("asset_known", F.col("_asset").isNotNull())
    for c in cols:
        default = params.UNKNOWN_ASSET[c]
        out = out.withColumn(c, F.when(F.col("asset_known"), F.col("_asset")[c]).otherwise(F.lit(default)))
    return out.drop("_id", "_ip", "_by_id", "_by_ip", "_asset")


def resolved_asset(df: DataFrame, assets: DataFrame, dst: Column, src: Column, given: Column) -> DataFrame:
    """Add ``asset_id`` from the address, else the event's own value, else UNKNOWN."""
    address = F.coalesce(F.when(dst != "", dst), src)
    owners = _one_per_ip(assets).select(F.col("ip").alias("_ip"), F.col("asset_id").alias("_owner"))
    joined = df.withColumn("_address", address).join(small_side(owners), F.col("_address") == F.col("_ip"), "left")
    return joined.withColumn("asset_id", F.coalesce("_owner", F.when(given != "", given), F.lit("UNKNOWN"))).drop(
        "_address", "_ip", "_owner"
    )


def normalized(df: DataFrame, raw: str = "raw", as_of: Column | None = None) -> DataFrame:
    """Source type, canonical field map, entities, event time and fingerprint."""
    fields = F.col(raw)
    out = df.withColumn("source_type", records.source_type(fields))
    out = out.withColumn("normalized", records.canonical_fields(fields, F.col("source_type")))
    # Texts that several patterns read are columns, so that a record builds each once.
    out = out.withColumn("_values_text", text.values_text(fields)).withColumn("_time_text", records.time_text(fields))
    out = out.withColumn("entities", text.named_entities(F.col("_values_text")))
    need_ip = (F.coalesce(records.item(F.col("normalized"), "src_ip"), F.lit("")) == "") & F.col("entities.ip").isNotNull()
    filled = F.map_concat(
        F.map_filter(F.col("normalized"), lambda k, _: k != "src_ip"), F.create_map(F.lit("src_ip"), F.col("entities.ip"))
    )
    out = out.withColumn("normalized", F.when(need_ip, filled).otherwise(F.col("normalized")))
    out = out.withColumn("event_time", records.read_time(F.col("_time_text"), as_of if as_of is not None else F.lit(None).cast("timestamp"))).drop("_values_text", "_time_text")
    return out.withColumn("content_fingerprint", records.content_fingerprint(F.col("normalized")))


def marked_membership(df: DataFrame, key: Column, members: DataFrame, member_key: str, name: str) -> DataFrame:
    """Boolean column: is the key in the member table."""
    ids = members.select(F.col(member_key).alias("_member")).distinct()
    return (
        df.join(small_side(ids), key == F.col("_member"), "left")
        .withColumn(name, F.col("_member").isNotNull())
        .drop("_member")
    )


def _pieces(text: Column, size: int) -> Column:
    """All substrings of one length."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    return F.coalesce(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))), F.array().cast("array<string>"))


GRAM = 3


def uncovered_by_goals(df: DataFrame, key: str, goals: DataFrame, goal: str) -> DataFrame:
    """Rows whose key is in no goal text, ignoring case. A null key is in none, an empty one in every goal.

    An index of the goals' grams of ``GRAM`` characters: a key can only be in goals that hold its rarest gram, and those are
    checked for the whole key; a key with a gram that no goal has is in none. Shorter keys are grams themselves.
    """
    texts = goals.select(F.lower(goal).alias("_goal")).where("_goal is not null").distinct()
    texts = texts.select("_goal", F.xxhash64("_goal").alias("_g1"), F.xxhash64(F.lit(1), "_goal").alias("_g2"))
    pieces = F.array_distinct(F.concat(*[_pieces(F.col("_goal"), size) for size in range(1, GRAM + 1)]))
    grams = texts.select("_g1", "_g2", F.explode(pieces).alias("_gram"))
    keys = df.select(F.lower(key).alias("_key")).where("_key is not null").distinct()
    spread = grams.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    short = keys.where(F.length("_key") < GRAM).join(spread.select(F.col("_gram").alias("_key")), "_key", "left_semi")
    own = keys.where(F.length("_key") >= GRAM).select("_key", F.explode(F.array_distinct(_pieces(F.col("_key"), GRAM))).alias("_gram"))
    rarest = own.join(spread, "_gram", "left").groupBy("_key").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_r"))
    looked = rarest.where("_r.n > 0").select("_key", F.col("_r._gram").alias("_gram"))
    found = looked.join(grams, "_gram").join(texts, ["_g1", "_g2"]).where(F.contains("_goal", "_key")).select("_key")
    empty = texts.limit(1).select(F.lit("").alias("_key"))
    covered = found.union(short).union(empty).distinct().withColumnRenamed("_key", "_covered")
    return df.join(covered, F.lower(df[key]) == F.col("_covered"), "left_anti")


REPUTATION_FIELDS = ("malicious", "suspicious", "undetected", "harmless", "vulns", "tags")


def hunt_score(kind: Column, malicious: Column, suspicious: Column, undetected: Column, harmless: Column, vulns: Column, tags: Column) -> Column:
    """Share of vendors against an indicator, more for an address with known weaknesses or a command-and-control tag; 0 when nothing is known."""
    from vigilframe.functions.scoring import reputation_score

    base = reputation_score(*[F.coalesce(c, F.lit(0)) for c in (malicious, suspicious, undetected, harmless)])
    risky = (kind == "ip") & (F.coalesce(F.size(vulns) > 0, F.lit(False)) | F.coalesce(F.exists(tags, lambda t: F.lower(t) == "c2"), F.lit(False)))
    return F.when(risky, F.least(F.lit(1.0), base + F.lit(0.05))).otherwise(base)


def with_reputation(iocs: DataFrame, reputation: DataFrame, as_of: Column, ttl_hours: int = params.REPUTATION_TTL_HOURS) -> DataFrame:
    """Hunt score per indicator from a downloaded reputation table.

    ``reputation``: type, value, malicious, suspicious, undetected, harmless,
    vulns, tags, cached_at. Rows older than the time to live are ignored.
    """
    fresh = reputation.where((records.micros(as_of) - records.micros(F.col("cached_at"))) <= F.lit(ttl_hours * 3_600_000_000))
    latest = fresh.groupBy("type", "value").agg(*[F.max_by(F.col(c), "cached_at").alias(c) for c in REPUTATION_FIELDS])
    out = iocs.join(latest, ["type", "value"], "left")
    return out.withColumn("hunt_score", hunt_score(F.col("type"), *[F.col(c) for c in REPUTATION_FIELDS]))
