"""Conflict-constrained best-fit packing of documents into bins of equal capacity."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.words import words
from vigilframe.session import scratch_path

CAPACITY, PER_SOURCE = 2048, 2
# Bounds of what one task packs: words and documents in a shard.
SHARD_WORDS, SHARD_DOCS = 4_000_000, 5_000


class Bins:
    """Open bins ordered by residual room; each carries a bitmap of sources and one of duplicate clusters.

    A source has ``per_source`` bits, so that many of its pieces fit in a bin; a cluster has one.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (residual, bin), ascending
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def put(self, size: int, source: int, cluster: int | None) -> int:
        """The tightest bin with room and without conflict, the oldest of equals; else a new one. A lone text has no cluster."""
        twin = 0 if cluster is None else 1 << cluster
        lowest = source * self.per_source
        mask = ((1 << self.per_source) - 1) << lowest
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            room, number = self.order[at]
            if not self.clusters[number] & twin and self.sources[number] & mask != mask:
                del self.order[at]
                break
            at += 1
        else:
            room, number = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        taken = (self.sources[number] & mask) >> lowest
        self.sources[number] |= ((taken + 1) | taken) << lowest  # the lowest free bit of the source
        self.clusters[number] |= twin
        if room > size:
            insort(self.order, (room - size, number))
        return number


def pack_shard(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Best-fit in order of decreasing size. A longer document is cut into full pieces, each a bin of its own, and a rest.

    Bits are numbered within the shard; only clusters with two rests or more need one.
    """
    rows = rows.assign(rest=rows["n_words"] % capacity).sort_values(["rest", "doc_id", "cluster"], ascending=[False, True, True], kind="stable")
    source_bits = {s: i for i, s in enumerate(pd.unique(rows["source"]))}
    often = rows.loc[rows["rest"] > 0, "cluster"].value_counts()
    cluster_bits = {c: i for i, c in enumerate(sorted(often[often > 1].index))}
    bins, out, full = Bins(capacity, per_source), [], 0
    for row, (n, rest, source, cluster) in enumerate(zip(rows["n_words"], rows["rest"], rows["source"], rows["cluster"], strict=True)):
        for piece in range(n // capacity):
            out.append((row, piece, piece * capacity, (piece + 1) * capacity, -1 - full))
            full += 1
        if rest:
            number = bins.put(rest, source_bits[source], cluster_bits.get(cluster))
            out.append((row, n // capacity, n - rest, n, number))
    table = pd.DataFrame(out, columns=["row", "piece", "begin", "end", "bin"])
    table["bin"] = table["bin"].where(table["bin"] >= 0, len(bins.sources) - 1 - table["bin"])
    table["place"] = table.groupby("bin").cumcount()
    return table.assign(**{c: rows[c].to_numpy()[table["row"]] for c in ("shard", "doc_id", "source", "cluster")})


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_words and cluster (digest of the lower-cased words, the same for copies) of each row; null source is a source."""
    w = words(F.lower(F.col("text")))
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(source, F.lit("")).alias("source"), F.struct(
        F.size(w).cast("long").alias("n"), F.xxhash64(F.array_join(w, " ")).alias("c")).alias("_m")).select(
            "doc_id", "source", F.col("_m.n").alias("n_words"), F.col("_m.c").alias("cluster"))


def packed(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece: doc_id, piece, begin and end (word offsets in the document), n_words, bin_id, place.

    No bin exceeds ``capacity`` words, holds two rests of one duplicate cluster, or more than ``per_source`` rests of one source.
    Rows without words (null or empty texts) get one row with n_words 0 and null bin_id and place. Rows that repeat a doc_id are
    separate documents. A null doc_id or source is a value like others.

    Sizes are written once; rows are dealt evenly over shards whose size is bounded, whatever the sources, and each shard is packed
    by best-fit on its own. Bins are only left underfilled at the end of each shard.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "packing")
    measured(docs).write.parquet(path)
    sizes = spark.read.parquet(path)
    total = sizes.where("n_words > 0").agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("words"), F.count("*").alias("docs")).first()
    shards = max(1, -(-total["words"] // SHARD_WORDS), -(-total["docs"] // shard_docs))
    shard = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(shards)).alias("shard")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows["doc_id"] = rows["doc_id"].astype("Int64")
        out = pack_shard(rows, capacity, per_source)
        out["bin_id"] = out["shard"] * (1 << 32) + out["bin"]
        out["n_words"] = out["end"] - out["begin"]
        return out[["doc_id", "piece", "begin", "end", "n_words", "bin_id", "place"]]

    schema = "doc_id long, piece long, begin long, end long, n_words long, bin_id long, place long"
    full = sizes.where("n_words > 0").select(shard, "*").groupBy("shard").applyInPandas(run, schema)
    none = sizes.where("n_words = 0").selectExpr("doc_id", "0L piece", "0L begin", "0L end", "0L n_words", "cast(null as long) bin_id", "cast(null as long) place")
    return full.unionByName(none)
