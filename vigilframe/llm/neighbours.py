"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.session import scratch_path


_BAND = np.int64(0x6A09E667F3BCC909)


@dataclass(frozen=True)
class Search:
    """Tables, projections in each, cell width on unit vectors, buckets visited in each table; entries per group of buckets and per task."""

    tables: int = 8
    projections: int = 12
    width: float = 2.75
    probes: int = 600
    group: int = 50_000
    task: int = 100_000
    least_groups: int = 16


def perturbations(k: int, count: int) -> list[tuple[int, ...]]:
    """Sets of ranks among the 2k sorted border distances, in order of expected total; the empty set (own bucket) first.

    Rank j and rank 2k - 1 - j are the two borders of one projection and exclude each other. The expected squared distance of
    rank j is that of order statistics of uniform borders.
    """
    score = [(j + 1) * (j + 2) / (4 * (k + 1) * (k + 2)) if j < k else 1 - (2 * k - j) / (k + 1) + (2 * k - j) * (2 * k - j + 1) / (4 * (k + 1) * (k + 2)) for j in range(2 * k)]
    out, heap = [()], [(score[0], (0,))]
    while heap and len(out) < count:
        total, ranks = heapq.heappop(heap)
        if len({min(r, 2 * k - 1 - r) for r in ranks}) == len(ranks):
            out.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * k:
            heapq.heappush(heap, (total - score[last] + score[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (total + score[last + 1], (*ranks, last + 1)))
    return out


class Hashes:
    """Tables of p-stable hash functions floor((a.x + b) / w) on unit vectors of ``dim`` + 1 components."""

    def __init__(self, dim: int, tables: int, projections: int, width: float, probes: int, seed: int = 11):
        draw = np.random.default_rng(seed)
        self.tables, self.k, self.width = tables, projections, width
        self.a = draw.normal(size=(dim + 1, tables * projections))
        self.b = draw.uniform(0, width, tables * projections)
        self.odd = draw.integers(1 << 62, size=(tables, projections), dtype=np.int64) * 2 + 1
        self.salt = draw.integers(1 << 62, size=tables, dtype=np.int64)
        sets = perturbations(projections, probes)
        # (set, rank) incidence over the 2k ranks
        self.sets = np.zeros((len(sets), 2 * projections), dtype=bool)
        for i, ranks in enumerate(sets):
            self.sets[i, list(ranks)] = True

    def _slots(self, unit: np.ndarray) -> np.ndarray:
        return ((unit @ self.a + self.b) / self.width).reshape(len(unit), self.tables, self.k)

    def _codes(self, cells: np.ndarray, table: int, band: np.ndarray | int) -> np.ndarray:
        with np.errstate(over="ignore"):
            code = (cells.astype(np.int64) * self.odd[table]).sum(axis=-1) + self.salt[table] + np.asarray(band, np.int64) * _BAND
        code = code.view(np.uint64)
        code = (code ^ (code >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return (code ^ (code >> np.uint64(29))).view(np.int64)

    def buckets(self, unit: np.ndarray, band: np.ndarray) -> np.ndarray:
        """(rows, tables) bucket codes; the code of a table's bucket holds for that table and band only."""
        cells = np.floor(self._slots(unit))
        return np.stack([self._codes(cells[:, t], t, band) for t in range(self.tables)], axis=1)

    def whole(self, band: np.ndarray) -> np.ndarray:
        """The codes of bands that are one bucket."""
        return self._codes(np.full((len(band), self.k), 1 << 40), 0, band)

    def probed(self, unit: np.ndarray, bands: list[int]) -> np.ndarray:
        """(rows, tables * bands * probes) codes of the buckets to visit, most promising first in each table of a band."""
        slots = self._slots(unit)
        cells = np.floor(slots)
        part = slots - cells
        out = []
        for t in range(self.tables):
            near = np.concatenate([part[:, t], 1 - part[:, t]], axis=1)  # to the lower, to the upper neighbour
            order = np.argsort(near, axis=1, kind="stable")
            step = np.where(order < self.k, -1, 1)
            which = order % self.k
            moves = np.zeros((len(unit), len(self.sets), self.k), dtype=np.int64)
            rows = np.arange(len(unit))
            for r in range(2 * self.k):
                for s in np.flatnonzero(self.sets[:, r]):
                    moves[rows, s, which[:, r]] += step[:, r]
            out += [self._codes(cells[:, t][:, None, :] + moves, t, band) for band in bands]
        return np.concatenate(out, axis=1)



def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _lengths(vectors: np.ndarray) -> np.ndarray:
    most = np.abs(vectors).max(axis=1, keepdims=True)
    return most[:, 0] * np.sqrt(((vectors / most) ** 2).sum(axis=1))


def _bands(vectors: np.ndarray, longest: float) -> np.ndarray:
    """How often the longest length can be divided by the root of two before it falls below a vector's own."""
    return np.maximum(0, np.floor(2 * (np.log2(longest) - np.log2(_lengths(vectors))))).astype(np.int64)


def _placed(vectors: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Vectors on the unit sphere of one more dimension: among those of one ``top``, nearness to a placed query falls as the inner product rises."""
    x = vectors / top[:, None]
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))], axis=1)


def _aimed(vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True)), np.zeros((len(vectors), 1))], axis=1)


def _group(codes: np.ndarray, groups: int) -> np.ndarray:
    return ((codes.view(np.uint64) >> np.uint64(8)) % np.uint64(groups)).astype(np.int32)


def _best(score: np.ndarray, ident: np.ndarray, count: int) -> np.ndarray:
    """Positions of the ``count`` highest scores, ties by the smaller id."""
    if len(score) > count:
        least = np.partition(score, len(score) - count)[len(score) - count]
        near = np.flatnonzero(score >= least)
        return near[np.lexsort((ident[near], -score[near]))[:count]]
    return np.lexsort((ident, -score))


def nearest(queries: DataFrame, vectors: DataFrame, count: int = 20, search: Search = Search()) -> DataFrame:
    """The ``count`` vectors found with the largest inner product for each query: query_id, rank (from 1), vec_id, score.

    Both inputs hold vec_id and embedding; further columns are ignored. A query's own vec_id is no candidate. Unusable vectors
    (see ``usable``), null ids, and vectors of another length than that of the smallest vec_id take no part; an empty table gives
    an empty result. Repeated rows count once; a query id with several vectors searches with the least. Equal vectors are hashed and
    compared once, with their ``count + 1`` smallest ids, which is all a result can hold. Ties go to the smaller vec_id.

    Vectors are dealt into bands of length, each shorter than the one before by the root of two, scaled by the greatest length of their band and lifted
    to the unit sphere, so that distance order is inner product order in a band, and hashed in ``tables`` tables of the band by
    floor((a.x + b) / width) over Gaussian projections. A query visits its own and perturbed buckets of all bands in order of
    estimated success; a band with no more vectors than that would be buckets is compared whole. A query that finds less than ``count`` is compared with all vectors. Entries and visits meet by group of buckets; a group with more than ``task`` entries is split over tasks,
    and its visits go to each. Only the best ``count`` of each task leave it; the tables' candidates are then merged.
    """
    known = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    known = known.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    length = known.agg(F.min_by(F.size("v"), "vec_id").alias("n")).first()["n"]
    schema = "query_id long, rank int, vec_id long, score double"
    if length is None:
        return known.sparkSession.createDataFrame([], schema)
    known = known.where(F.size("v") == length)
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = asked.where(F.col("query_id").isNotNull() & usable(F.col("v")) & (F.size("v") == length)).groupBy("query_id").agg(F.min("v").alias("v"))
    fewest = Window.partitionBy("v").orderBy("vec_id")
    classes = known.distinct().withColumn("_place", F.row_number().over(fewest)).where(F.col("_place") <= count + 1)
    classes = classes.groupBy("v").agg(F.min("vec_id").alias("ident"), F.array_sort(F.collect_set("vec_id")).alias("members"))
    facts = known.agg(F.max(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda a, b: a + b)).alias("square"), F.count("*").alias("n")).first()
    longest, groups = float(np.sqrt(facts["square"])) * (1 + 1e-12), max(search.least_groups, -(-facts["n"] * search.tables // search.group))

    def hashes() -> Hashes:
        return Hashes(length, search.tables, search.projections, search.width, search.probes)

    def banded(batches):
        tops, rows = {}, {}
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"))
                for band, top in zip(_bands(v, longest).tolist(), _lengths(v).tolist(), strict=True):
                    tops[band] = max(top, tops.get(band, 0.0))
                    rows[band] = rows.get(band, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(tops), pa.int64()), pa.array(list(tops.values()), pa.float64()), pa.array(list(rows.values()), pa.int64())], ["band", "top", "n"])

    facts_of = known.select("v").mapInArrow(banded, "band long, top double, n long").groupBy("band").agg(F.max("top"), F.sum("n"))
    bands, tops, sizes = map(np.array, zip(*sorted(map(tuple, facts_of.collect())), strict=True))
    small = sizes <= search.tables * search.probes

    def bucketed(made: Hashes, v: np.ndarray) -> np.ndarray:
        band = _bands(v, longest)
        at = np.searchsorted(bands, band)
        return np.where(small[at][:, None], made.whole(band)[:, None], made.buckets(_placed(v, tops[at]), band))

    def counted(batches):
        made, total = hashes(), np.zeros(groups, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_group(bucketed(made, _matrix(batch.column("v"))), groups).ravel(), minlength=groups)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(groups, dtype=np.int32)), pa.array(total)], ["g", "n"])

    def entered(batches):
        made = hashes()
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                v = _matrix(part.column("v"))
                codes = bucketed(made, v)
                rows = np.repeat(np.arange(len(v)), search.tables)
                raw = np.ascontiguousarray(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_group(codes, groups).ravel()), pa.array(codes.ravel()), part.column("ident").take(pa.array(rows)), pa.array([raw[i].tobytes() for i in rows], pa.binary())],
                    ["g", "code", "ident", "v"],
                )

    def visits(batches):
        made = hashes()
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                v = np.ascontiguousarray(_matrix(part.column("v")))
                codes = np.broadcast_to(made.whole(bands[small]), (len(v), small.sum()))
                if not small.all():
                    codes = np.concatenate([codes, made.probed(_aimed(v), bands[~small].tolist())], axis=1)
                ids, out = part.column("query_id").to_pylist(), []
                for i, row in enumerate(codes):
                    home = _group(row, groups)
                    order = np.argsort(home, kind="stable")
                    where = np.searchsorted(home[order], np.arange(groups + 1))
                    out += [(g, ids[i], v[i].tobytes(), np.sort(row[order[where[g] : where[g + 1]]]).tobytes()) for g in range(groups) if where[g] < where[g + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["g", "query_id", "v", "codes"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            code = left.column("code").to_numpy()
            order = np.argsort(code, kind="stable")
            code, ident = code[order], left.column("ident").to_numpy()[order]
            x = np.frombuffer(b"".join(left.column("v").to_pylist()), np.float64).reshape(len(code), length)[order]
            for q, raw, codes in zip(right.column("query_id").to_pylist(), right.column("v").to_pylist(), right.column("codes").to_pylist(), strict=True):
                codes = np.frombuffer(codes, np.int64)
                a, b = np.searchsorted(code, codes), np.searchsorted(code, codes, side="right")
                full = b > a
                size = (b - a)[full]
                if not len(size):
                    continue
                at = np.repeat(a[full] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                found, first = np.unique(ident[at], return_index=True)
                # Row by row, so that a score does not depend on the rows around it.
                score = np.einsum("ij,j->i", x[at[first]], np.frombuffer(raw, np.float64))
                best = _best(score, found, count + 1)
                out.append((np.full(len(best), q), found[best], score[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": columns[0], "ident": columns[1], "score": columns[2]})

    parts = classes.select("ident", "v").mapInArrow(counted, "g int, n long").groupBy("g").agg(F.sum("n").alias("n"))
    parts = parts.select("g", F.greatest(F.lit(1), F.ceil(F.col("n") / search.task)).cast("int").alias("parts"))
    entries = classes.select("ident", "v").mapInArrow(entered, "g int, code long, ident long, v binary").join(parts, "g")
    entries = entries.withColumn("part", F.pmod(F.xxhash64("ident"), F.col("parts")).cast("int")).drop("parts")
    visited = asked.mapInArrow(visits, "g int, query_id long, v binary, codes binary").join(parts, "g")
    visited = visited.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = entries.groupBy("g", "part").cogroup(visited.groupBy("g", "part")).applyInArrow(meet, "query_id long, ident long, score double")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "ident")
    found = found.groupBy("query_id", "ident").agg(F.max("score").alias("score")).withColumn("_place", F.row_number().over(ranked)).where(F.col("_place") <= count + 1)
    # A few rows a query, written so that the search runs once.
    path = scratch_path(known.sparkSession, "neighbours")
    found.select("query_id", "ident", "score").write.parquet(path)
    found = known.sparkSession.read.schema("query_id long, ident long, score double").parquet(path)

    def members(found: DataFrame) -> DataFrame:
        return found.join(classes.select("ident", "members"), "ident").select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")

    enough = members(found).groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= count)
    short = asked.join(enough, "query_id", "left_anti").select("query_id", "v")
    if not short.isEmpty():
        deal = max(1, -(-facts["n"] // search.task))

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            if left.num_rows and right.num_rows:
                x, ident = _matrix(left.column("v").combine_chunks()), left.column("ident").to_numpy()
                for q, v in zip(right.column("query_id").to_pylist(), _matrix(right.column("v").combine_chunks()), strict=True):
                    score = np.einsum("ij,j->i", x, v)
                    best = _best(score, ident, count + 1)
                    out.append((np.full(len(best), q), ident[best], score[best]))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            return pa.table({"query_id": columns[0], "ident": columns[1], "score": columns[2]})

        dealt = classes.select("ident", "v", F.pmod(F.xxhash64("ident"), F.lit(deal)).cast("int").alias("part"))
        sent = short.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
        rest = dealt.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(compare, "query_id long, ident long, score double")
        found = found.join(short.select("query_id"), "query_id", "left_anti").unionByName(rest)
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = members(found).withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= count)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
