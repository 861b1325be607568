"""Vector codes: product quantisation in integers, nearest entries found by slicing sorted coordinates and intersecting bit masks.

For each part of the vectors the entries of its codebook are sorted by each coordinate, and the sets of the first 0, 1, 2, ... entries
of that order are kept as bit masks of 64-bit words. The entries within a radius of a vector in one coordinate are the difference of
two such prefix masks; the masks of all coordinates, intersected, hold every entry within that radius of the vector. An initial radius
gives few candidates; the best of them bounds the distance of the nearest entry, and the slices of that bound hold it for certain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from vigilframe.session import scratch_path, small_side

# Below this size, squared distances of vectors of up to 500 components fit in 64 bits.
LIMIT = 1 << 26
# Parts of vectors whose candidates are compared at a time.
ROWS = 512


@dataclass(frozen=True)
class Code:
    """Parts of a vector, entries of each part's codebook, rounds of refinement, integer steps in a unit."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


class Slices:
    """Nearest entry of one codebook by slices of its sorted coordinates."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        count, width = entries.shape
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.entries, order, axis=0).T.copy()
        held = np.zeros((width, count + 1, -(-count // 64) * 64), dtype=bool)
        for d in range(width):
            held[d, 1:][np.arange(count), order[:, d]] = True
        # Row k of a coordinate: the first k entries of its order.
        held = np.logical_or.accumulate(held, axis=1)
        self.prefix = np.packbits(held, axis=2, bitorder="little").view(np.uint64)
        # Half the mean spread of a coordinate: a cell that holds few entries.
        self.first_radius = max(1, int(np.ptp(self.entries, axis=0).mean() / 4)) if count else 1

    def within(self, rows: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, entry) of all entries that differ by at most the row's radius in every coordinate, by row and entry."""
        mask = None
        for d, line in enumerate(self.sorted):
            low = np.searchsorted(line, rows[:, d] - radius, side="left")
            high = np.searchsorted(line, rows[:, d] + radius, side="right")
            # The lower prefix is a subset of the higher one.
            part = self.prefix[d, high] ^ self.prefix[d, low]
            mask = part if mask is None else mask & part
        bits = np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little")
        return np.nonzero(bits)

    def _best(self, rows: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of the nearest candidate, the lowest entry on ties; -1 and -1 without one."""
        entry, distance = np.full(len(rows), -1, dtype=np.int64), np.full(len(rows), -1, dtype=np.int64)
        row, candidate = self.within(rows, radius)
        if len(row):
            apart = rows[row] - self.entries[candidate]
            square = np.einsum("ij,ij->i", apart, apart)
            order = np.lexsort((candidate, square, row))
            lead = order[np.r_[True, row[order][1:] != row[order][:-1]]]
            entry[row[lead]], distance[row[lead]] = candidate[lead], square[lead]
        return entry, distance

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each row and its squared distance; ties go to the lower entry."""
        entry, distance = np.full(len(rows), -1, dtype=np.int64), np.full(len(rows), -1, dtype=np.int64)
        for begin in range(0, len(rows), ROWS):
            part = rows[begin : begin + ROWS]
            radius = np.full(len(part), self.first_radius, dtype=np.int64)
            open_ = np.arange(len(part))
            while len(open_):
                e, d = self._best(part[open_], radius[open_])
                entry[begin + open_], distance[begin + open_] = e, d
                # Final once the radius covers the distance found; else look as far as that distance, or twice as far if nothing was found.
                bound = np.ceil(np.sqrt(d.clip(min=0).astype(np.float64))).astype(np.int64) + 1
                more = (d < 0) | (d > radius[open_] ** 2)
                radius[open_] = np.minimum(np.where(d < 0, radius[open_] * 2, np.maximum(bound, radius[open_])), (1 << 31) - 1)
                open_ = open_[more]
        return entry, distance


def _bounds(width: int, parts: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, width, parts + 1).astype(int) if width % parts else np.arange(parts + 1) * (width // parts)
    return [(int(a), int(b)) for a, b in zip(cuts, cuts[1:])]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, width)


def _sums(books: list[np.ndarray], width: int):
    """Per task: how many parts each entry is nearest to, and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        sums = [np.zeros_like(b) for b in books]
        for batch in batches:
            rows = _matrix(batch.column("steps"), width)
            for p, (a, b) in enumerate(_bounds(width, len(books))):
                entry, _ = slices[p].nearest(rows[:, a:b])
                np.add.at(counts[p], entry, 1)
                np.add.at(sums[p], entry, rows[:, a:b])
        for p, (count, total) in enumerate(zip(counts, sums)):
            used = np.flatnonzero(count)
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))],
                    ["part", "entry", "n", "total"],
                )

    return run


def _coded(books: list[np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        for batch in batches:
            rows = _matrix(batch.column("steps"), width)
            found = [slices[p].nearest(rows[:, a:b]) for p, (a, b) in enumerate(_bounds(width, len(books)))]
            digits = max(2, len(f"{max(len(b) for b in books) - 1:x}"))
            codes = ["".join(f"{e:0{digits}x}" for e in row) for row in zip(*(e.tolist() for e, _ in found))]
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(codes, pa.string()), pa.array(error, pa.int64()), batch.column("label")], ["vec_id", "code", "error", "label"])

    return run


def stepped(vectors: DataFrame, code: Code = Code()) -> tuple[DataFrame, int]:
    """(vec_id, label, steps) of the vectors that take part, and their length; steps is null where they fit no code.

    ``steps`` are the components as ``floor(scale * x)``. Null vectors and vectors with null, NaN or infinite components are left out.
    A vector of another length than the most frequent one (the longest of equally frequent ones), or with a component of 2**26
    steps or more, stays, with null steps.
    """
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where(F.col("x").isNotNull() & F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))))
    lengths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = lengths["width"] if lengths else 0
    fits = (F.size("x") == width) & (F.size("x") > 0) & F.forall("x", lambda v: F.abs(v * code.scale) < LIMIT)
    rows = rows.select("vec_id", "label", F.when(fits, F.transform("x", lambda v: F.floor(v * code.scale).cast("long"))).alias("steps"))
    return rows, width


def codebooks(steps: DataFrame, width: int, code: Code = Code()) -> list[np.ndarray]:
    """The codebook of each part: at first that part of the vectors with the smallest vec_ids, then mean components of the parts nearest.

    Each round reads all vectors once. Tasks send one sum per entry they used; what reaches the driver is bounded by the codebooks.
    """
    known = steps.where("steps is not null").select("vec_id", "steps")
    seeds = known.orderBy(F.col("vec_id").asc_nulls_last(), "steps").limit(code.entries).collect()
    if not seeds:
        return []
    whole = np.array([r["steps"] for r in seeds], dtype=np.int64)
    books = [whole[:, a:b].copy() for a, b in _bounds(width, code.parts)]
    for _ in range(code.rounds):
        sums = known.mapInArrow(_sums(books, width), "part int, entry int, n long, total array<long>")
        flat = sums.select("part", "entry", "n", F.posexplode("total").alias("place", "sum"))
        for r in flat.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).toLocalIterator():
            books[r["part"]][r["entry"], r["place"]] = r["sum"] // r["n"]
    return books


def vector_codes(vectors: DataFrame, code: Code = Code()) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows of vec_id, code, error, label, label_error; codebooks) of a table of vectors.

    ``vectors`` has vec_id, embedding (an array of numbers) and perhaps label; further columns are ignored. Components become integers
    ``floor(scale * x)``; each vector is cut into ``parts`` consecutive parts, as equal as can be, and each part is coded by its nearest
    entry: squared Euclidean distance, ties to the lower entry. ``code`` holds the entries in hexadecimal, two digits or more each;
    ``error`` is the sum of the squared distances, ``label_error`` its sum over the rows of equal label, null labels together.

    Null vectors and vectors with null or non-finite components give no row. Vectors whose length is not the most frequent one, or
    with components too large for 64-bit distances, shape no codebook and get a null code and error. Repeated rows each get a row
    and count each; null vec_ids are the last in the order of first entries. With fewer vectors than entries the codebooks are as short.
    An empty table gives no rows and no codebooks.
    """
    spark = vectors.sparkSession
    rows, width = stepped(vectors, code)
    path = scratch_path(spark, "codes-steps")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    books = codebooks(rows, width, code)
    schema = "vec_id long, code string, error long, label string"
    fit, rest = rows.where("steps is not null"), rows.where("steps is null")
    out = rest.select("vec_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), "label")
    if books:
        out = fit.mapInArrow(_coded(books, width), schema).unionByName(out)
    path = scratch_path(spark, "codes")
    out.write.parquet(path)
    out = spark.read.parquet(path)
    # Null labels together: they join by a flag and an empty string. The written sums have a known size, so a broadcast is checked.
    key = [F.col("label").isNull().alias("_none"), F.coalesce("label", F.lit("")).alias("_label")]
    path = scratch_path(spark, "codes-labels")
    out.groupBy(*key).agg(F.sum("error").alias("label_error")).write.parquet(path)
    out = out.select("*", *key).join(small_side(spark.read.parquet(path)), ["_none", "_label"])
    return out.select("vec_id", "code", "error", "label", "label_error"), books


def decoded(rows: DataFrame, books: list[np.ndarray], code: Code = Code()) -> DataFrame:
    """``rows`` (vec_id, code) with the approximate vector of each code, in the units of the original; null for a null code."""
    spark = rows.sparkSession
    digits = max(2, len(f"{max((len(b) for b in books), default=1) - 1:x}"))
    out = F.array().cast("array<double>")
    table = spark.createDataFrame([Row(books=[[[float(v) / code.scale for v in e] for e in b.tolist()] for b in books])], "books array<array<array<double>>>")
    held = rows.crossJoin(F.broadcast(table))  # one row, as large as the codebooks
    for p in range(len(books)):
        entry = F.conv(F.substring("code", p * digits + 1, digits), 16, 10).cast("int")
        out = F.concat(out, F.get(F.get("books", p), entry))
    return held.select("vec_id", F.when(F.col("code").isNotNull(), out).alias("embedding"))
