"""Exact cosine search with a metric index, and vector-table helpers.

A vector side of checked size in bytes is broadcast. A larger one gets an
index: each vector belongs to its nearest pivot, and a block holds vectors of
one pivot within a range of angles to it. Angles obey the triangle inequality,
so the angle of a query to a pivot bounds its angles to a whole block from both
sides. A query visits the blocks that surely hold ``k`` vectors, and then only
those that may hold a nearer one than the k-th best found. A task multiplies
the matrices of one block and its visitors; only the best ``k`` leave it.

Where queries use some leading components only, no similarity exceeds the norm
that a vector has in these. Such vectors are dealt into blocks by that norm, a
few vectors near the mean of the queries tell what each query's k-th best
reaches, and vectors of a lower norm than any query's are not shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.functions.records import bound
from vigilframe.session import scratch_path

QUERY_STEP, VECTOR_STEP = 1024, 2048
# Vectors near the mean of the queries that all queries are compared with first.
SEED_ROWS = 2048
# Similarities a task holds at a time, and bytes of queries it hands on at a time.
CELLS, VISIT_BYTES = 2 << 20, 16 << 20
# Largest vector side, in bytes of its matrix, that is broadcast; largest matrix of one block.
BROADCAST_BYTES, BLOCK_BYTES = 32 << 20, 32 << 20
PIVOTS, ANGLE_STEPS = 64, 256
# Slack of the bounds: similarities are compared at 12 digits, which are up to 1.5e-6 of angle.
ANGLE_SLACK = 4e-6
# The same for a bound by lengths along and across a direction; two similarities that may be equal at 12 digits.
LENGTH_SLACK, TIE_SLACK = 1e-6, 2e-12


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalized(vector: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    return bound(
        vector,
        lambda v: bound(
            l2_norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))
        ),
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def cosine(a: Column, b: Column) -> Column:
    return bound(l2_norm(a) * l2_norm(b), lambda n: F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0)))


def checked_vectors(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Fail on a vector of another length."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {dim} values, got "), F.size(vector).cast("string")))
    ok = F.when(F.size(vector) == dim, F.col(vector)).otherwise(wrong.cast("array<float>"))
    return df.withColumn(vector, ok)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = values.reshape(len(flat), -1)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _least_copies(m: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of all equal rows, ascending. Rows of equal digests are compared, so none is lost to a digest that two rows share."""
    odd = np.random.RandomState(0).randint(1, 1 << 62, size=m.shape[1]).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    digest = (np.ascontiguousarray(m).view(np.uint64) * odd).sum(axis=1)
    order = np.argsort(digest, kind="stable")
    same = np.flatnonzero(digest[order[1:]] == digest[order[:-1]]) + 1
    starts = np.ones(len(order), dtype=bool)
    for at in range(0, len(same), VECTOR_STEP):
        some = same[at : at + VECTOR_STEP]
        starts[some] = (m[order[some]] != m[order[some - 1]]).any(axis=1)
    first = np.flatnonzero(starts)
    place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return np.sort(order[place < k])


def _along(m: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signed length of each row along ``centre``, and its length across."""
    along = m @ centre
    return along, np.sqrt(np.maximum(np.einsum("ij,ij->i", m, m) - along**2, 0.0))


def _best(qid: np.ndarray, qm: np.ndarray, vid: np.ndarray, vm: np.ndarray, k: int, exclude_same: bool, kth: np.ndarray | None = None) -> pa.RecordBatch:
    """The k best vectors per query; ties go to the lower id.

    As many queries and vectors at a time as make ``CELLS`` similarities. A similarity is at most the product of the lengths along the
    mean of the queries and that of the lengths across it; vectors that cannot reach any k-th best of the queries at hand are not
    multiplied. ``kth``: what each query's k-th best is known to reach (with other vectors); matches below it are left out.
    """
    out, step = [], 1
    if len(qid) and len(vid):
        centre = qm.mean(axis=0)
        centre = centre / max(np.linalg.norm(centre), 1e-300)
        q_along, q_across = _along(qm, centre)
        turn = np.argsort(q_across, kind="stable")
        # Only components that some query has count for the length across.
        own = qm.any(axis=0)
        along, across = _along(vm if own.all() else vm[:, own], centre[own])
        near = np.argsort(-along, kind="stable")
        vid, vm, along, across = vid[near], vm[near], along[near], across[near]
        width = min(len(vid), max(VECTOR_STEP, 4 * k))
        step = min(QUERY_STEP, max(1, CELLS // width))
    for at in range(0, len(qid) if len(vid) else 0, step):
        some = turn[at : at + step]
        rows, ids = qm[some], qid[some]
        low = np.full(len(some), -np.inf) if kth is None else kth[some]
        found = []

        def compared(places):
            sims = rows @ vm[places].T
            if exclude_same:
                sims[ids[:, None] == vid[places][None, :]] = -np.inf
            return sims

        def kept(sims, places):
            # Similarities are compared at 12 digits; only those that may tie with the k-th are rounded.
            r, c = np.nonzero(sims >= low[:, None] - TIE_SLACK)
            found.append((r, vid[places][c], np.round(sims[r, c], 12)))

        done = 0
        if np.isneginf(low).any():
            done, first = width, slice(0, width)
            sims = compared(first)
            if k <= width:
                low = np.maximum(low, np.partition(sims, width - k)[:, width - k])
            kept(sims, first)
        most = np.maximum(q_along[some].min() * along[done:], q_along[some].max() * along[done:]) + q_across[some].max() * across[done:]
        left = done + np.flatnonzero(most >= low.min() - LENGTH_SLACK)
        for first in range(0, len(left), width):
            places = left[first : first + width]
            kept(compared(places), places)
        if not found:
            continue
        r, v, value = (np.concatenate(part) for part in zip(*found, strict=True))
        order = np.lexsort((v, -value, r))
        r, v, value = r[order], v[order], value[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r) + 1
        good = (rank <= k) & np.isfinite(value)
        out.append((some[r[good]], v[good], value[good], rank[good]))
    row, v, value, rank = (np.concatenate(part) for part in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4
    back = np.argsort(row, kind="stable")
    return pa.RecordBatch.from_arrays(
        [pa.array(qid[row[back]].astype(np.int64)), pa.array(v[back].astype(np.int64)), pa.array(value[back].astype(np.float64)), pa.array(rank[back].astype(np.int64))],
        names=["query_id", "vector_id", "similarity", "rank"],
    )


def _sorted_side(table: pa.Table, copies: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids ascending and the matrix; of equal vectors only the ``copies`` lowest ids."""
    ids = table["vector_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, m = ids[order], _matrix(table["v"])[order]
    if copies is None or not m.shape[1]:
        return ids, m
    some = _least_copies(m, copies)
    return ids[some], m[some]


MATCH_SCHEMA = "query_id bigint, vector_id bigint, similarity double, rank bigint"


@dataclass(frozen=True)
class MetricIndex:
    """Pivots, the blocks of the index (pivot, least and greatest angle, rows, parts), and the vectors with block and part.

    Pivot -1 stands for zero vectors, which have a similarity of 0 with everything.
    """

    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    parts: np.ndarray
    vectors: DataFrame

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest angle that each query (a unit or zero vector) can have to a vector of each block."""
        to_pivot = np.arccos(np.clip(q @ self.pivots.T, -1.0, 1.0)) if len(self.pivots) else np.zeros((len(q), 1))
        at = to_pivot[:, self.pivot.clip(min=0)]
        least = np.maximum(np.maximum(at - self.high, self.low - at), 0.0)
        most = np.minimum(at + self.high, math.pi)
        right = (self.pivot < 0)[None, :] | ~q.any(axis=1)[:, None]
        return np.where(right, math.pi / 2, least), np.where(right, math.pi / 2, most)

    def sure(self, most: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Which blocks each query visits first, and an angle within which ``k`` vectors surely are."""
        order = np.argsort(most, axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        first = np.zeros(most.shape, dtype=bool)
        np.put_along_axis(first, order, before < k, axis=1)
        enough = self.rows.sum() >= k
        return first, np.where(first, most, 0.0).max(axis=1) if enough else np.full(len(most), math.pi)


def _placed(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("v"))
            pivot, angle = np.full(len(m), -1, dtype=np.int32), np.full(len(m), math.pi / 2)
            some = m.any(axis=1)
            if some.any():
                angles = np.arccos(np.clip(m[some] @ pivots.T, -1.0, 1.0))
                pivot[some] = angles.argmin(axis=1)
                angle[some] = angles.min(axis=1)
            step = np.minimum((angle * (ANGLE_STEPS / math.pi)).astype(np.int32), ANGLE_STEPS - 1)
            columns = [batch.column("vector_id"), batch.column("v"), pa.array(pivot), pa.array(angle), pa.array(step)]
            yield pa.RecordBatch.from_arrays(columns, ["vector_id", "v", "pivot", "angle", "step"])

    return run


def _blocks(steps: list, block_rows: int) -> tuple[list, list]:
    """Blocks [pivot, least and greatest angle, rows] of steps (pivot, step, rows, low, high), and (pivot, step, block) of each step."""
    blocks, where = [], []
    for r in sorted(steps, key=lambda r: (r["pivot"], r["step"])):
        # Neighbouring steps of one pivot share a block until it is full; a fuller step is one block in several parts.
        if not blocks or blocks[-1][0] != r["pivot"] or blocks[-1][3] + r["rows"] > block_rows:
            blocks.append([r["pivot"], r["low"], r["high"], 0])
        blocks[-1][2], blocks[-1][3] = r["high"], blocks[-1][3] + r["rows"]
        where.append((r["pivot"], r["step"], len(blocks) - 1))
    return blocks, where


def _dealt(placed: DataFrame, where: list, parts: list) -> DataFrame:
    """(vector_id, v, block, part) of rows with pivot and step."""
    known = placed.sparkSession.createDataFrame([(*w, parts[w[2]]) for w in where], "pivot int, step int, block int, parts int")
    return placed.join(F.broadcast(known), ["pivot", "step"]).select("vector_id", "v", "block", F.pmod(F.xxhash64("vector_id"), F.col("parts")).cast("int").alias("part"))


def metric_index(vectors: DataFrame, block_rows: int, pivots: int = PIVOTS) -> MetricIndex:
    """Index of (vector_id, v). Pivots are vectors in the order of a hash; what the driver sees is bounded by pivots and angle steps."""
    spark = vectors.sparkSession
    some = vectors.where(F.exists("v", lambda x: x != 0))
    seeds = some.orderBy(F.xxhash64("vector_id"), "vector_id").limit(pivots).select("v").toArrow()
    centres = _matrix(seeds["v"]) if seeds.num_rows else np.zeros((0, 0))
    path = scratch_path(spark, "metric-index")
    placed = vectors.select("vector_id", "v").mapInArrow(_placed(centres), f"vector_id bigint, v {vectors.schema['v'].dataType.simpleString()}, pivot int, angle double, step int")
    placed.write.parquet(path)
    placed = spark.read.parquet(path)
    steps = placed.groupBy("pivot", "step").agg(F.count(F.lit(1)).alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()
    blocks, where = _blocks(steps, block_rows)
    parts = [math.ceil(b[3] / block_rows) for b in blocks]
    dealt = _dealt(placed, where, parts)
    column = lambda i, kind: np.array([b[i] for b in blocks], dtype=kind)
    return MetricIndex(centres, column(0, np.int64), column(1, np.float64), column(2, np.float64), column(3, np.int64), np.array(parts, dtype=np.int64), dealt)


def _pieces(batch: pa.RecordBatch, visit: np.ndarray, parts: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns ``names`` of each query for every part of the blocks it visits, with block and part."""
    query, block = np.nonzero(visit)
    times = parts[block]
    query, block = np.repeat(query, times), np.repeat(block, times)
    part = np.arange(len(block)) - np.repeat(np.cumsum(times) - times, times)
    # A batch repeats its queries for every block they visit, so it is handed on in pieces of bounded size.
    piece = max(1, VISIT_BYTES * len(batch) // max(1, batch.nbytes))
    for first in range(0, len(query), piece):
        some = slice(first, first + piece)
        chosen = batch.take(pa.array(query[some]))
        columns = [chosen.column(name) for name in names] + [pa.array(block[some].astype(np.int32)), pa.array(part[some].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, [*names, "block", "part"])


def _visits(index: MetricIndex, k: int, floor: float, again: bool):
    """Rows (query_id, q, block, part) of the blocks to visit first, or, ``again``, of those that may still hold a better vector."""
    pivots, pivot, low, high, rows, parts = index.pivots, index.pivot, index.low, index.high, index.rows, index.parts
    farthest = math.acos(max(-1.0, min(1.0, floor)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = MetricIndex(pivots, pivot, low, high, rows, parts, None)
        for whole in batches:
            for at in range(0, len(whole), QUERY_STEP):
                batch = whole.slice(at, QUERY_STEP)
                least, most = held.bounds(_matrix(batch.column("q")))
                visit, within = held.sure(most, k)
                if again:
                    kth = batch.column("kth").to_numpy(zero_copy_only=False)
                    within = np.minimum(within, np.where(np.isnan(kth), math.pi, np.arccos(np.clip(kth, -1.0, 1.0))))
                    visit = ~visit & (least <= within[:, None] + ANGLE_SLACK)
                visit &= least <= farthest + ANGLE_SLACK
                yield from _pieces(batch, visit, parts, ["query_id", "q"])

    return run


def visits(index: MetricIndex, queries: DataFrame, k: int, floor: float = -1.0, again: bool = False) -> DataFrame:
    """(query_id, q, block, part) of the visits of ``queries`` (query_id, q; ``again``: kth, the k-th best similarity so far or null)."""
    return queries.mapInArrow(_visits(index, k, floor, again), f"query_id bigint, q {queries.schema['q'].dataType.simpleString()}, block int, part int")


def _visited(vectors: DataFrame, visiting: DataFrame, k: int, exclude_same: bool, q_blocks: int) -> DataFrame:
    """The k best of each visited part for each visitor; visitors of one part are dealt into ``q_blocks`` tasks."""

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_batches([_best(np.empty(0, np.int64), np.empty((0, 1)), np.empty(0, np.int64), np.empty((0, 1)), k, False)])
        kth = np.nan_to_num(a["kth"].to_numpy(), nan=-np.inf) if "kth" in a.column_names else None
        side = _sorted_side(b, None if exclude_same else k)
        return pa.Table.from_batches([_best(a["query_id"].to_numpy(), _matrix(a["q"]), *side, k, exclude_same, kth)])

    left = visiting.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int"))
    right = vectors.select("*", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    keys = ["block", "part", "qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block, MATCH_SCHEMA)


@dataclass(frozen=True)
class QuerySpace:
    """Number of leading components that queries have, and their mean as a unit vector of these."""

    used: int
    centre: np.ndarray


def _query_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    used, width, total = 0, 0, np.zeros(0)
    for batch in batches:
        if batch.num_rows:
            m = _matrix(batch.column("q"))
            some = np.flatnonzero(m.any(axis=0))
            used, width = max(used, some[-1] + 1 if len(some) else 0), m.shape[1]
            total = m.sum(axis=0) if not len(total) else total + m.sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array([used], pa.int32()), pa.array([width], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["used", "width", "total"])


def query_space(q: DataFrame) -> QuerySpace | None:
    """The leading components that any of the queries (q) has; None if these are none, or all but one or fewer."""
    sums = q.select("q").mapInArrow(_query_sums, "used int, width int, total array<double>").where("width > 0").collect()
    used, width = max((r["used"] for r in sums), default=0), max((r["width"] for r in sums), default=0)
    if not 0 < used < width - 1:
        return None
    centre = np.sum([r["total"][:used] for r in sums], axis=0)
    return QuerySpace(used, centre / max(np.linalg.norm(centre), 1e-300))


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def _folded_queries(used: int):
    """Rows (query_id, q) with ``used`` components and a zero for the norm of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("q"))[:, : used + 1]
                m[:, used] = 0.0
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), _lists(m)], ["query_id", "q"])

    return run


def _folded_vectors(space: QuerySpace):
    """Rows (vector_id, v, angle, step, near): a vector's components that queries have and the norm of the rest, its least angle to
    any vector without a rest, and the step of its similarity with the mean of the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("v"))
                head, tail = m[:, : space.used], np.linalg.norm(m[:, space.used :], axis=1)
                length = np.linalg.norm(head, axis=1)
                # A zero vector has a similarity of 0 with everything.
                angle = np.where(length + tail > 0, np.arctan2(tail, length), math.pi / 2)
                step = np.minimum((angle * (ANGLE_STEPS / math.pi)).astype(np.int32), ANGLE_STEPS - 1)
                near = np.floor((head @ space.centre) * ANGLE_STEPS).astype(np.int32)
                columns = [batch.column("vector_id"), _lists(np.column_stack([head, tail])), pa.array(angle), pa.array(step), pa.array(near)]
                yield pa.RecordBatch.from_arrays(columns, ["vector_id", "v", "angle", "step", "near"])

    return run


def _seeds(v: DataFrame, least: int) -> pa.Table:
    """About ``least`` vectors (at most twice as many) that are nearest to the mean of the queries."""
    taken, where = 0, None
    for r in v.groupBy("near").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("near")).collect():
        share = max(1, r["rows"] // (least - taken))
        where, taken = (F.col("near") > r["near"]) | ((F.col("near") == r["near"]) & (F.pmod(F.xxhash64("vector_id"), F.lit(share)) == 0)), taken + r["rows"]
        if taken >= least:
            break
    return v.where(where).select("vector_id", "v").toArrow()


def _reaching(low: np.ndarray, parts: np.ndarray, floor: float):
    """Rows (query_id, q, kth, block, part) of the blocks, from the angles ``low`` on, that may hold one of a query's k best."""
    farthest = math.acos(max(-1.0, min(1.0, floor)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), QUERY_STEP):
                batch = whole.slice(at, QUERY_STEP)
                kth = batch.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
                within = np.minimum(np.where(np.isnan(kth), math.pi, np.arccos(np.clip(kth, -1.0, 1.0))), farthest)
                yield from _pieces(batch, low[None, :] <= within[:, None] + ANGLE_SLACK, parts, ["query_id", "q", "kth"])

    return run


def _matches_by_angle(q: DataFrame, v: DataFrame, k: int, exclude_same: bool, floor: float, block_rows: int) -> DataFrame:
    """``top_matches`` of folded queries and vectors: a vector is compared with the queries whose k-th best its angle allows."""
    spark = q.sparkSession
    side = spark.sparkContext.broadcast(_sorted_side(_seeds(v, max(SEED_ROWS, 2 * k + 2))))

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vid, vm = side.value
        for batch in batches:
            if batch.num_rows:
                qid, kth = np.arange(batch.num_rows), np.full(batch.num_rows, np.nan)
                ids, m = batch.column("query_id").to_numpy(zero_copy_only=False), _matrix(batch.column("q"))
                step = max(1, CELLS // max(1, len(vid)))
                for at in range(0, len(qid) if k <= len(vid) else 0, step):
                    sims = m[at : at + step] @ vm.T
                    if exclude_same:
                        sims[ids[at : at + step, None] == vid[None, :]] = -np.inf
                    best = np.partition(sims, len(vid) - k)[:, len(vid) - k]
                    kth[at : at + step] = np.where(np.isfinite(best), best, np.nan)
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("q"), pa.array(kth, from_pandas=True)], ["query_id", "q", "kth"])

    path = scratch_path(spark, "similarity-queries")
    q.mapInArrow(seeded, "query_id bigint, q array<double>, kth double").write.parquet(path)
    q = spark.read.parquet(path)
    rows, known, least = q.agg(F.count(F.lit(1)), F.count("kth"), F.min("kth")).first()
    within = min(math.pi if known < rows else math.acos(max(-1.0, min(1.0, least))), math.acos(max(-1.0, min(1.0, floor)))) if rows else 0.0
    v = v.where(F.col("angle") <= within + ANGLE_SLACK).withColumn("pivot", F.lit(0))
    steps = v.groupBy("pivot", "step").agg(F.count(F.lit(1)).alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()
    blocks, where = _blocks(steps, block_rows)
    parts = [math.ceil(b[3] / block_rows) for b in blocks]
    visiting = q.mapInArrow(_reaching(np.array([b[1] for b in blocks]), np.array(parts, dtype=np.int64), floor), "query_id bigint, q array<double>, kth double, block int, part int")
    # Where few parts are left, their visitors are dealt into more tasks.
    tasks = 4 * spark.sparkContext.defaultParallelism
    q_blocks = max(1, math.ceil(rows / block_rows), min(math.ceil(rows / QUERY_STEP), math.ceil(tasks / max(1, sum(parts)))))
    found = _visited(_dealt(v, where, parts), visiting, k, exclude_same, q_blocks)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vector_id")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def top_matches(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    *,
    query_id: str = "query_id",
    vector_id: str = "vector_id",
    query_vector: str = "query_vector",
    vector: str = "vector",
    exclude_same: bool = False,
    floor: float = -1.0,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
    pivots: int = PIVOTS,
) -> DataFrame:
    """(query_id, vector_id, similarity, rank) of the ``k`` nearest vectors.

    Ties go to the lower vector id. Ids must be BIGINT and unique. A vector side
    whose matrix has at most ``broadcast_bytes`` is broadcast and the queries
    stream past it without a shuffle; a larger one is searched through its metric
    index, with blocks of at most ``block_bytes``. ``floor``: matches below this
    similarity may be left out, and blocks that hold no others are not visited.
    Components behind the last that any query has do not enter a product: of
    these only the vectors' norm is kept.
    """
    q = queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(query_vector).alias("q"))
    v = vectors.select(F.col(vector_id).cast("bigint").alias("vector_id"), F.col(vector).alias("v"))
    spark = queries.sparkSession
    space = query_space(q)
    if space:
        q = q.mapInArrow(_folded_queries(space.used), "query_id bigint, q array<double>")
        path = scratch_path(spark, "similarity-vectors")
        v.mapInArrow(_folded_vectors(space), "vector_id bigint, v array<double>, angle double, step int, near int").write.parquet(path)
        v = spark.read.parquet(path)
    n_vec, width = v.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    row_bytes = 8 * max(1, width or 0) + 8
    if n_vec * row_bytes <= broadcast_bytes:
        side = spark.sparkContext.broadcast(_sorted_side(v.select("vector_id", "v").toArrow(), None if exclude_same else k) if n_vec else (np.empty(0, np.int64), np.empty((0, 1))))

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vid, vm = side.value
            for batch in batches:
                if batch.num_rows and len(vid):
                    yield _best(batch.column("query_id").to_numpy(zero_copy_only=False), _matrix(batch.column("q")), vid, vm, k, exclude_same)

        return q.mapInArrow(probe, MATCH_SCHEMA)
    block_rows = max(1, block_bytes // row_bytes)
    if space:
        return _matches_by_angle(q, v, k, exclude_same, floor, block_rows)
    index = metric_index(v, block_rows, pivots)
    path = scratch_path(spark, "similarity-queries")
    q.write.parquet(path)
    q = spark.read.parquet(path)
    q_blocks = max(1, math.ceil(q.count() / block_rows))
    wanted = k + 1 if exclude_same else k  # the query itself may be among the vectors
    path = scratch_path(spark, "similarity-first")
    _visited(index.vectors, visits(index, q, wanted, floor), k, exclude_same, q_blocks).write.parquet(path)
    first = spark.read.parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vector_id")
    kth = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("similarity").alias("kth"))
    rest = visits(index, q.join(kth, "query_id", "left"), wanted, floor, again=True)
    found = first.unionByName(_visited(index.vectors, rest, k, exclude_same, q_blocks))
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)
