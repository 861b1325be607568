"""N-gram Jaccard join: prefix filters under several global token orders, intersected before verification.

A link needs ``percent`` % of the union, so under any total order of all shingles two linked sets share one of their first
``n - ceil(percent * n / 100) + 1`` shingles. Each of two orders splits the shingles into classes by a hash of their own and
sorts by (class, number of texts, hash): rare shingles come first, and a text needs only its first class or two, a known share
of its shingles. Document counts are exact: every text sends those shingles, packed, to the tasks of their hash, which send back
the counts of those in two texts or more.

Texts that share a prefix shingle of the first order meet in its bucket. Buckets up to ``small`` texts compare compact count
vectors there, whose overlap bounds the intersection from above; the pairs left must also share a prefix shingle of the second
order, and are then verified on their whole sets. Larger buckets (groups of near copies) are cut into blocks; tasks take two
blocks, verify all their pairs on whole sets with matrix products, and hand on a spanning forest of the links only.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.components import components
from vigilframe.llm.words import mix, shingles, text_chunks, words_of
from vigilframe.session import scratch_path

ORDERS = (1, 2)
# Entries that a map task packs at a time, and that a task of one part of the shingles holds. A packed row repeats the keys of its
# holders, so the shuffle is smaller the more entries of a text share a row: many entries at a time, few parts.
FLUSH, PART = 500_000, 500_000
# Largest bucket whose pairs are compared by count vectors; texts in a block of a larger one.
SMALL, BLOCK = 256, 1024
# Mean number of shingles in a cell of a count vector, and least cells.
PER_CELL, CELLS = 4, 64


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for row, data, offsets in text_chunks(batch.column("text")):
            yield batch.slice(row, len(offsets) - 1), len(offsets) - 1, *shingles(words_of(data, offsets), width)


def _key(values: np.ndarray) -> int:
    return int.from_bytes(blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def _cells(values: np.ndarray) -> bytes:
    """Shingles per hash cell, a power of two of cells; empty if a count needs more than a byte."""
    cells = CELLS
    while cells * PER_CELL < len(values):
        cells *= 2
    counts = np.bincount((mix(values, 9) >> np.uint64(20)).astype(np.int64) & (cells - 1), minlength=cells)
    return b"" if counts.max(initial=0) > 255 else counts.astype(np.uint8).tobytes()


def _shapes(width: int):
    def run(batches):
        for batch, rows, values, first in _sets(batches, width):
            n = np.diff(first)
            parts = [values[first[i] : first[i + 1]] for i in range(rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n.astype(np.int64)),
                    pa.array([_key(v) if len(v) else None for v in parts], pa.int64()),
                    pa.array([_cells(v) if len(v) else None for v in parts], pa.binary()),
                ],
                ["doc_id", "n", "key", "cells"],
            )

    return run


def _pack(values: np.ndarray) -> bytes:
    """Byte planes of an integer array, compressed."""
    planes = values.reshape(-1, 1).view(np.uint8).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(packed: bytes, kind, count: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=count * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, count).T).view(kind).reshape(count)


PACKED = "part int, ord int, tokens binary, size int, owner binary, keys binary, slack binary, holders int, counts binary"


def _packed(part, order, token, key, slack, last, count=None) -> Iterator[pa.RecordBatch]:
    """One row per part: sorted tokens as differences, who holds them, and each holder once."""
    if not len(part):
        return
    sort = np.lexsort((key, token, part))
    part, token, key, slack, last = part[sort], token[sort], key[sort], slack[sort], last[sort]
    count = None if count is None else count[sort]
    starts, out = np.flatnonzero(np.diff(part, prepend=-1)), []
    for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
        holders, at, owner = np.unique(key[a:b], return_index=True, return_inverse=True)
        out.append({
            "part": int(part[a]), "ord": order, "size": int(b - a), "holders": len(holders),
            "tokens": _pack(np.diff(token[a:b], prepend=np.uint64(0))),
            "owner": _pack((owner.astype(np.uint32) << np.uint32(1)) | last[a:b].astype(np.uint32)),
            "keys": _pack(np.diff(holders, prepend=np.int64(0))), "slack": _pack(slack[a:b][at].astype(np.uint32)),
            "counts": None if count is None else _pack(count[a:b].astype(np.uint32)),
        })
    if out:
        kinds = {"part": pa.int32(), "ord": pa.int32(), "size": pa.int32(), "holders": pa.int32()}
        names = [x.split()[0] for x in PACKED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[x] for r in out], kinds.get(x, pa.binary())) for x in names], names)


def _unpacked(table: pa.Table):
    token, key, slack, last, count, order = [], [], [], [], [], []
    for r in table.to_pylist():
        owner = _unpack(r["owner"], np.uint32, r["size"])
        keys, spare = np.cumsum(_unpack(r["keys"], np.int64, r["holders"])), _unpack(r["slack"], np.uint32, r["holders"])
        token.append(np.cumsum(_unpack(r["tokens"], np.uint64, r["size"])))
        last.append((owner & 1).astype(bool))
        key.append(keys[owner >> 1])
        slack.append(spare[owner >> 1])
        count.append(_unpack(r["counts"], np.uint32, r["size"]) if r["counts"] is not None else np.zeros(r["size"], np.uint32))
        order.append(np.full(r["size"], r["ord"], np.int8))
    return tuple(map(np.concatenate, (token, key, slack, last, count, order)))


def _classes(percent: int) -> int:
    """Classes that the shingles are split into: few enough that one mostly holds the prefix."""
    return max(2, 40 // max(1, 100 - percent))


def _prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def _entries(width: int, percent: int, parts: int):
    """The shingles that can be in a prefix: whole classes, until they hold the prefix."""
    classes = _classes(percent)

    def run(batches):
        kept = {o: [] for o in ORDERS}
        size = 0

        def flush():
            for o in ORDERS:
                if kept[o]:
                    token, key, slack, last = map(np.concatenate, zip(*kept[o], strict=True))
                    yield from _packed((token & np.uint64(0xFFFFF)).astype(np.int64) % parts, o, token, key, slack, last)
                    kept[o].clear()

        for _, rows, values, first in _sets(batches, width):
            n = np.diff(first)
            text = np.repeat(np.arange(rows), n)
            key = np.array([_key(values[first[i] : first[i + 1]]) for i in range(rows)], dtype=np.int64)
            need = _prefix_sizes(n, percent)
            for o in ORDERS:
                token = mix(values, 100 + o)
                kind = ((token >> np.uint64(32)) * np.uint64(classes) >> np.uint64(32)).astype(np.int64)
                held = np.bincount(text * classes + kind, minlength=rows * classes).reshape(rows, classes)
                until = np.cumsum(held, axis=1)
                end = (until < need[:, None]).sum(axis=1).clip(max=classes - 1)
                slack = until[np.arange(rows), end] - need
                send = kind <= end[text]
                at = text[send]
                kept[o].append((token[send], key[at], slack[at], kind[send] == end[at]))
                size += int(send.sum())
            if size >= FLUSH:
                yield from flush()
                size = 0
        yield from flush()

    return run


def _shared(parts: int):
    """Entries of one part of the tokens: those in two texts or more, with their counts, packed by text."""

    def run(table: pa.Table) -> pa.Table:
        token, key, slack, last, _, order = _unpacked(table)
        sort = np.lexsort((key, token))
        token, key, slack, last = token[sort], key[sort], slack[sort], last[sort]
        fresh = np.r_[True, (token[1:] != token[:-1]) | (key[1:] != key[:-1])]
        token, key, slack, last = token[fresh], key[fresh], slack[fresh], last[fresh]
        _, which, counts = np.unique(token, return_inverse=True, return_counts=True)
        count = counts[which]
        keep = count > 1
        batches = list(_packed((key[keep].astype(np.uint64) % np.uint64(parts)).astype(np.int64), int(order[0]), token[keep], key[keep], slack[keep], last[keep], count[keep]))
        return pa.Table.from_batches(batches, schema=batches[0].schema if batches else _PACKED_SCHEMA)

    return run


_PACKED_SCHEMA = pa.schema([(x.split()[0], {"int": pa.int32(), "binary": pa.binary()}[x.split()[1]]) for x in PACKED.split(", ")])


def _prefixes(table: pa.Table) -> pa.Table:
    """Shared prefix tokens of each text under both orders; texts without any under one of them have no partner."""
    token, key, slack, last, count, order = _unpacked(table)
    sort = np.lexsort((token, count, last, order, key))
    token, key, slack, last, order = token[sort], key[sort], slack[sort], last[sort], order[sort]
    group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (order[1:] != order[:-1])]) - 1
    size = np.bincount(group)
    begin = np.cumsum(size) - size
    left = size[group] - (np.arange(len(key)) - begin[group])
    keep = ~last | (left > slack)
    token, key, order = token[keep], key[keep], order[keep]
    out = {}
    for o in ORDERS:
        own = order == o
        ids, at, n = np.unique(key[own], return_index=True, return_counts=True)
        out[o] = (ids, token[own].view(np.int64), at, n)
    both = np.intersect1d(out[1][0], out[2][0])
    columns = [pa.array(both, pa.int64())]
    for o in ORDERS:
        ids, tokens, at, n = out[o]
        pick = np.searchsorted(ids, both)
        offsets = np.r_[0, np.cumsum(n[pick])]
        flat = np.repeat(at[pick] - offsets[:-1], n[pick]) + np.arange(offsets[-1])
        columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens[flat], pa.int64())))
    return pa.Table.from_arrays(columns, ["key", "p1", "p2"])


def _folded(cells: np.ndarray, size: int) -> np.ndarray:
    return cells.reshape(-1, size).sum(axis=0)


def _bucket_pairs(percent: int):
    """Pairs of a bucket whose count vectors allow a link; rows come sorted by bucket."""

    def pairs(key, n, cells):
        sort = np.argsort(n, kind="stable")
        rows = {}
        for at, i in enumerate(sort):
            later = sort[at + 1 :]
            later = later[(100 * n[i] >= percent * n[later]) & (key[later] != key[i])]
            if not len(later):
                continue
            if len(cells[i]) == 0:
                picked = later
            else:
                size = len(cells[i])
                mine = np.frombuffer(cells[i], np.uint8).astype(np.int64)
                if (size, "m") not in rows:
                    rows[(size, "m")] = {}
                known = rows[(size, "m")]
                for j in later:
                    if j not in known:
                        known[j] = _folded(np.frombuffer(cells[j], np.uint8).astype(np.int64), size) if len(cells[j]) else np.full(size, 1 << 20)
                most = np.minimum(np.stack([known[j] for j in later]), mine).sum(axis=1)
                picked = later[100 * most >= percent * (n[i] + n[later] - most)]
            for j in picked:
                yield min(key[i], key[j]), max(key[i], key[j])

    def run(batches):
        held = []

        def done(rows):
            out = sorted(set(pairs(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), [r[3] for r in rows]))) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([int(p[i]) for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        made = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("token", "key", "n", "cells")), strict=True):
                if held and held[0][0] != row[0]:
                    made.append(done(held))
                    held = []
                    if len(made) >= 2000:
                        yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                        made = []
                held.append(row)
        made.append(done(held))
        yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    return run


def _forest(percent: int, count: int, links) -> list[tuple[int, int]]:
    parent = list(range(count))
    tree = []
    for i, j in links:
        a, b = int(i), int(j)
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[max(a, b)] = min(a, b)
            tree.append((int(i), int(j)))
    return tree


def _block_links(percent: int):
    """Two blocks of a large bucket, or one: a spanning forest of the links between their texts."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key = table.column("key").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("values").to_pylist()]
        n = np.array([len(s) for s in sets])
        _, value, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), n)
        keep = often[value] > 1
        _, value = np.unique(value[keep], return_inverse=True)
        owner = owner[keep]
        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        sort = np.argsort(value, kind="stable")
        value, owner = value[sort], owner[sort]
        for low in range(0, int(value.max(initial=-1)) + 1, 2048):
            a, b = np.searchsorted(value, [low, low + 2048])
            part = np.zeros((len(sets), 2048), dtype=np.float32)
            part[owner[a:b], value[a:b] - low] = 1
            both += part @ part.T
        i, j = np.nonzero(np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1))
        tree = _forest(percent, len(sets), zip(i, j, strict=True))
        return pa.table({"a": pa.array([int(key[x]) for x, _ in tree], pa.int64()), "b": pa.array([int(key[y]) for _, y in tree], pa.int64())})

    return run


def _set_rows(width: int):
    def run(batches):
        for batch, rows, values, first in _sets(batches, width):
            parts = [values[first[i] : first[i + 1]] for i in range(rows)]
            keys = [_key(v) for v in parts]
            keep = [i for i, k in enumerate(batch.column("key").to_pylist()) if k == keys[i]]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in keep], pa.int64()), pa.array([parts[i].tobytes() for i in keep], pa.binary())], ["key", "values"])

    return run


def _verified(percent: int):
    def run(batches):
        for batch in batches:
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            good = []
            for x, y in zip(left, right, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id.

    ``docs`` has doc_id and text; further columns are ignored. A-Z is lower-cased; words are runs of characters other than blank and
    0x09-0x0D; the set holds the distinct ``width``-word shingles, of a shorter text the whole sequence. Two documents link when
    ``100 * |A & B| >= percent * |A | B|``; component_id is the smallest doc_id reachable by links.
    Null or wordless texts have an empty set and link with nothing. Rows that repeat a doc_id get a row each and are one node, linked
    by all their texts. A null doc_id takes no part and gets a null component. Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = scratch_path(spark, "jaccard-shapes")
    texts.mapInArrow(_shapes(width), "doc_id long, n long, key long, cells binary").write.parquet(path)
    shapes = spark.read.parquet(path)
    known = shapes.where("doc_id is not null and key is not null")
    total = known.agg(F.sum("n")).first()[0] or 0
    parts = max(4, -(-total // (_classes(percent) * PART)))
    packed = texts.where("doc_id is not null").select("text").mapInArrow(_entries(width, percent, parts), PACKED)
    packed = packed.groupBy("ord", "part").applyInArrow(_shared(parts), PACKED)
    prefix = packed.groupBy("part").applyInArrow(_prefixes, "key long, p1 array<long>, p2 array<long>")
    one = known.groupBy("key").agg(F.min(F.struct("doc_id", "n", "cells")).alias("s")).select("key", "s.*")
    path = scratch_path(spark, "jaccard-prefixes")
    prefix.join(one, "key").write.parquet(path)
    members = spark.read.parquet(path)
    posted = members.select("key", F.explode("p1").alias("token"))
    sizes = posted.groupBy("token").agg(F.count("*").alias("texts")).where("texts > 1")
    posted = posted.join(sizes, "token")

    small = posted.where(F.col("texts") <= SMALL).join(members.select("key", "n", "cells"), "key")
    small = small.repartition("token").sortWithinPartitions("token").select("token", "key", "n", "cells")
    pairs = small.mapInArrow(_bucket_pairs(percent), "a long, b long").distinct()
    second = members.select("key", "p2")
    pairs = pairs.join(second.select(F.col("key").alias("a"), F.col("p2").alias("x")), "a").join(second.select(F.col("key").alias("b"), F.col("p2").alias("y")), "b")
    path = scratch_path(spark, "jaccard-pairs")
    pairs.where(F.arrays_overlap("x", "y")).select("a", "b").write.parquet(path)
    pairs = spark.read.parquet(path)

    blocks = F.ceil(F.col("texts") / BLOCK).cast("int")
    large = posted.where(F.col("texts") > SMALL).withColumn("mine", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    large = large.select("token", "key", "mine", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    large = large.select("token", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).union(large.select("key")).distinct()
    wanted = members.select("key", "doc_id").join(wanted, "key", "left_semi")
    path = scratch_path(spark, "jaccard-sets")
    texts.join(wanted, "doc_id").select("key", "text").mapInArrow(_set_rows(width), "key long, values binary").dropDuplicates(["key"]).write.parquet(path)
    sets = spark.read.parquet(path)

    links = pairs.join(sets.select(F.col("key").alias("a"), F.col("values").alias("left")), "a")
    links = links.join(sets.select(F.col("key").alias("b"), F.col("values").alias("right")), "b").select("a", "b", "left", "right")
    links = links.mapInArrow(_verified(percent), "a long, b long")
    forest = large.join(sets, "key").groupBy("token", "i", "j").applyInArrow(_block_links(percent), "a long, b long")
    first = known.groupBy("doc_id").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a < z").select("doc_id", "a")
    same = known.join(first, "doc_id").select("a", F.col("key").alias("b"))
    roots = components(links.union(forest).union(same))
    return _answer(shapes, known, roots)


def _answer(shapes: DataFrame, known: DataFrame, roots: DataFrame) -> DataFrame:
    lone = known.groupBy("key").agg(F.min("doc_id").alias("first")).join(roots.withColumnRenamed("node", "key"), "key", "left")
    lone = lone.select("key", "first", F.coalesce("root", "key").alias("root"))
    least = lone.groupBy("root").agg(F.min("first").alias("component"))
    named = lone.join(least, "root").select("key", "component")
    out = shapes.drop("cells").join(named, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id. All columns are kept as they are.

    Documents without words and rows without doc_id stay. Of rows that repeat a kept doc_id, the smallest text stays.
    """
    found = jaccard_components(docs, width, percent)
    drop = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    # Rows are packed, so no name can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rest = rows.join(drop, F.col("row.doc_id") == F.col("gone"), "left_anti")
    twice = rest.where(F.col("row.doc_id").isNotNull()).groupBy(F.col("row.doc_id").alias("twice")).agg(F.count("*").alias("rows")).where("rows > 1").select("twice")
    once = rest.join(twice, F.col("row.doc_id") == F.col("twice"), "left_anti")
    again = rest.join(twice, F.col("row.doc_id") == F.col("twice"), "left_semi")
    again = again.groupBy("row.doc_id").agg(F.min_by("row", F.struct(F.col("row.text").isNull(), F.col("row.text"))).alias("row")).select("row")
    return once.unionByName(again).select(*[F.col("row")[c].alias(c) for c in docs.columns])
