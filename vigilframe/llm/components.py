"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    Each round points the larger neighbours of a node at its smallest neighbour, then does the same downwards, which ends with
    stars after about log(n) rounds. A round is two aggregations and joins; lineage is cut with a checkpoint, so a lost executor
    costs one round. Edges with a null end and loops are ignored.
    """
    kept = cut_lineage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") > F.col("b"))).distinct()
    )
    while True:
        both = kept.union(kept.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") > F.col("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = cut_lineage(small.select("e.*").where(F.col("a") > F.col("b")).distinct())
        if not after.exceptAll(kept).take(1) and not kept.exceptAll(after).take(1):
            break
        kept = after
    return kept.select(F.col("a").alias("node"), F.col("b").alias("root")).union(kept.select(F.col("b"), F.col("b")).distinct())
