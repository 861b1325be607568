"""Running windows that survive hot keys, and exact quantiles.

A plain ``partitionBy(key)`` running window puts all rows of a key into one
task. Here every key is split into ordered buckets: bucket totals are
pre-aggregated, a small window over the totals gives each bucket what came
before it, and the row-level window only spans one bucket. The rows are
shuffled once, on (key, bucket).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.session import cut_lineage

BUCKET = "_bucket"
# Rows of a bucket where the caller names none.
RANGE_ROWS = 1_000_000


def time_bucket(micros: Column, seconds: int) -> Column:
    return F.floor(micros / F.lit(seconds * 1_000_000)).cast("bigint")


def ranged(df: DataFrame, keys: list[str], order: list[Column]) -> tuple[DataFrame, Column]:
    """Rows dealt by ranges of (keys, order), and the number of the range as their bucket.

    There are as many ranges as make about ``RANGE_ROWS`` rows each, so a bucket is bounded however the rows are spread over keys
    and time. The ranges are written once, as every later step must see the same ones.
    """
    parts = -(-df.count() // RANGE_ROWS)
    if parts <= 1:
        return df, F.lit(0).cast("bigint")
    dealt = df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id().cast("bigint"))
    return cut_lineage(dealt), F.col("_range")


def _with_carry(df: DataFrame, keys: list[str], totals: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Join each (key, bucket) with window values over the key's bucket totals."""
    carry = totals.select(*keys, BUCKET, *[c.alias(n) for n, c in columns.items()])
    return df.join(carry, [*keys, BUCKET])


def running_sums(
    df: DataFrame, keys: list[str], order: list[Column], bucket: Column | None, measures: dict[str, Column]
) -> DataFrame:
    """Add inclusive running sums, exact under the total order ``order``.

    ``bucket`` must not decrease along ``order``; without one, rows are bucketed by ``ranged``. The keys must not be null.
    """
    if bucket is None:
        df, bucket = ranged(df, keys, order)
    staged = df.withColumn(BUCKET, bucket)
    totals = staged.groupBy(*keys, BUCKET).agg(*[F.sum(e).alias(f"_total_{n}") for n, e in measures.items()])
    before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = _with_carry(
        staged, keys, totals,
        {f"_before_{n}": F.coalesce(F.sum(f"_total_{n}").over(before), F.lit(0)) for n in measures},
    )
    local = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = carried.select(
        "*", *[(F.col(f"_before_{n}") + F.coalesce(F.sum(e).over(local), F.lit(0))).alias(n) for n, e in measures.items()]
    )
    return out.drop(BUCKET, "_range", *[f"_before_{n}" for n in measures])


def row_positions(df: DataFrame, keys: list[str], order: list[Column], bucket: Column | None = None, name: str = "seq") -> DataFrame:
    """Number the rows of each key from 1 along ``order``."""
    return running_sums(df, keys, order, bucket, {name: F.lit(1).cast("bigint")})


def running_moments(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    bucket: Column | None,
    values: list[str],
    seed: DataFrame | None = None,
) -> DataFrame:
    """Add running n, mean and sample variance per value column, current row included.

    ``seed`` (keys, _n, _mean_<v>, _m2_<v>) continues from an earlier state.
    Sums are taken around a per-key centre so that the variance does not cancel.
    Without a ``bucket``, rows are bucketed by ``ranged``.
    """
    if bucket is None:
        df, bucket = ranged(df, keys, order)
    staged = df.withColumn(BUCKET, bucket)
    totals = staged.groupBy(*keys, BUCKET).agg(
        F.count(F.lit(1)).alias("_cnt"),
        *[F.avg(v).alias(f"_avg_{v}") for v in values],
        *[(F.var_pop(v) * F.count(v)).alias(f"_dev_{v}") for v in values],
    )
    if seed is not None:
        totals = totals.join(seed, keys, "left")
    whole = Window.partitionBy(*keys)
    before = whole.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    seeded = (lambda c: F.coalesce(F.col(c), F.lit(0.0))) if seed is not None else (lambda c: F.lit(0.0))
    centres = {f"_centre_{v}": F.sum(F.col("_cnt") * F.col(f"_avg_{v}")).over(whole) / F.sum("_cnt").over(whole) for v in values}
    totals = totals.select("*", *[c.alias(n) for n, c in centres.items()])
    columns = {"_before_n": F.coalesce(F.sum("_cnt").over(before), F.lit(0)) + seeded("_n")}
    for v in values:
        gap = F.col(f"_avg_{v}") - F.col(f"_centre_{v}")
        seed_gap = seeded(f"_mean_{v}") - F.col(f"_centre_{v}")
        columns[f"_centre_{v}"] = F.col(f"_centre_{v}")
        columns[f"_before_s_{v}"] = F.coalesce(F.sum(F.col("_cnt") * gap).over(before), F.lit(0.0)) + seeded("_n") * seed_gap
        columns[f"_before_q_{v}"] = (
            F.coalesce(F.sum(F.col(f"_dev_{v}") + F.col("_cnt") * gap * gap).over(before), F.lit(0.0))
            + seeded(f"_m2_{v}")
            + seeded("_n") * seed_gap * seed_gap
        )
    carried = _with_carry(staged, keys, totals, columns)
    local = Window.partitionBy(*keys, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("_before_n") + F.count(F.lit(1)).over(local)
    sums = [n.cast("bigint").alias("n")]
    for v in values:
        gap = F.col(v) - F.col(f"_centre_{v}")
        sums.append((F.col(f"_before_s_{v}") + F.sum(gap).over(local)).alias(f"_s_{v}"))
        sums.append((F.col(f"_before_q_{v}") + F.sum(gap * gap).over(local)).alias(f"_q_{v}"))
    out = carried.select("*", *sums)  # one window operator for all sums
    for v in values:
        s, q = F.col(f"_s_{v}"), F.col(f"_q_{v}")
        out = out.withColumn(f"mean_{v}", F.col(f"_centre_{v}") + s / F.col("n"))
        spread = F.greatest(q - s * s / F.col("n"), F.lit(0.0))
        out = out.withColumn(f"var_{v}", F.when(F.col("n") > 1, spread / (F.col("n") - 1)))
    spare = [c for c in out.columns if c.startswith(("_before_", "_centre_", "_s_", "_q_")) or c in (BUCKET, "_range")]
    return out.drop(*spare)


def trailing_counts(df: DataFrame, keys: list[str], micros: str, seconds: int, name: str = "calls") -> DataFrame:
    """Count the rows of the key within the last ``seconds``, both ends included.

    Equal instants are pre-aggregated; each is used in its own time bucket and
    as context in the next one, so that no window spans more than two buckets.
    In the next bucket an instant is added and, after what is ``seconds``
    later, taken out again: one running sum, however many rows are in reach.
    """
    span = seconds * 1_000_000
    instants = df.groupBy(*keys, micros).agg(F.count(F.lit(1)).alias("_rows"))
    own = F.floor(F.col(micros) / F.lit(span)).cast("bigint")
    use = lambda bucket, at, rows, leaves: F.struct(bucket.alias("bucket"), at.alias("at"), rows.alias("rows"), F.lit(leaves).alias("leaves"))
    at, rows = F.col(micros), F.col("_rows")
    uses = F.array(use(own, at, rows, False), use(own + 1, at, rows, False), use(own + 1, at + F.lit(span), -rows, True))
    spread = instants.withColumn("_use", F.explode(uses)).withColumn(BUCKET, F.col("_use.bucket"))
    window = Window.partitionBy(*keys, BUCKET).orderBy("_use.at", "_use.leaves").rowsBetween(Window.unboundedPreceding, 0)
    counted = spread.withColumn(name, F.sum("_use.rows").over(window)).where((F.col(BUCKET) == own) & ~F.col("_use.leaves"))
    return df.join(counted.select(*keys, micros, name), [*keys, micros])


def sliding_sequences(
    df: DataFrame, order: list[Column], bucket: Column | None, payload: Column, length: int, chunk: int = 4096
) -> DataFrame:
    """(seq, sequence) for every full run of ``length`` consecutive rows.

    Rows are numbered globally and cut into chunks; the first chunk rows see the
    last ``length - 1`` rows of the chunk before.
    """
    numbered = row_positions(df.withColumn("_payload", payload), [], order, bucket)
    own = F.floor((F.col("seq") - 1) / chunk).cast("bigint")
    last = ((F.col("seq") - 1) % chunk) >= chunk - (length - 1)
    spread = numbered.select(
        "seq", "_payload", own.alias("_own"),
        F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))).alias(BUCKET),
    )
    window = Window.partitionBy(BUCKET).orderBy("seq").rowsBetween(-(length - 1), 0)
    return (
        spread.withColumn("sequence", F.collect_list("_payload").over(window))
        .where((F.size("sequence") == length) & (F.col(BUCKET) == F.col("_own")))
        .select("seq", "sequence")
    )


def exact_quantiles(df: DataFrame, value: Column, probs: list[float], cells: int = 2048, direct: int = 100_000) -> list[float]:
    """Quantiles with linear interpolation, found by narrowing a histogram.

    Every pass returns at most ``cells`` counts to the driver; values are only
    fetched from cells with at most ``direct`` rows.
    """
    vals = df.select(value.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n, low, high = vals.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if n == 0:
        return [math.nan for _ in probs]
    spots = [p * (n - 1) for p in probs]
    found: dict[int, float] = {}

    def narrow(ranks: list[int], low: float, high: float, offset: int, rows: int) -> None:
        if not ranks:
            return
        if low == high:
            found.update({r: low for r in ranks})
            return
        inside = vals.where(F.col("v").between(low, high))
        if rows <= direct:
            seen = offset
            todo = list(ranks)
            for v, c in inside.groupBy("v").count().orderBy("v").collect():
                while todo and todo[0] < seen + c:
                    found[todo.pop(0)] = v
                seen += c
            return
        width = (high - low) / cells
        cell = F.least(F.lit(cells - 1), F.floor((F.col("v") - F.lit(low)) / F.lit(width)))
        seen = offset
        for _, c, lo, hi in inside.groupBy(cell.alias("cell")).agg(F.count("v"), F.min("v"), F.max("v")).orderBy("cell").collect():
            narrow([r for r in ranks if seen <= r < seen + c], lo, hi, seen, c)
            seen += c

    narrow(sorted({i for s in spots for i in (math.floor(s), math.ceil(s))}), low, high, 0, n)
    return [found[math.floor(s)] + (found[math.ceil(s)] - found[math.floor(s)]) * (s - math.floor(s)) for s in spots]
