"""One JSON document of any size as rows of its elements, read by many tasks.

A file is cut at closing braces, which the text reader does inside byte ranges, so one file is many splits. Pieces that follow each
other are packed into chunks and written once; a chunk is a row and never moves again. Whether a chunk starts inside a string is the
parity of the quotes before it, and where an element ends follows from the depth of brackets outside strings; both are running sums
over a few numbers per chunk. Only the text before the first and after the last end in a chunk meets that of other chunks. No task
sees more than a few chunks or one element.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilframe.session import scratch_path, small_side
from vigilframe.sources.readers import json_fields, wrapped

# Bytes after which a chunk is full; a piece is never cut.
CHUNK = 1 << 20
_CHUNKS = "_file string, source string, _size long, _block long, _chunk long, data binary"
_KEY = ["_file", "_block", "_chunk"]
_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\f\r"))
_STEP = np.zeros(256, dtype=np.int64)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Texts between closing braces, with their place in the file."""
    lines = spark.read.option("lineSep", "}").text(path)
    meta = F.col("_metadata")
    return lines.select(
        F.col("value").cast("binary").alias("value"), meta["file_path"].alias("_file"), meta["file_name"].alias("source"),
        meta["file_size"].alias("_size"), meta["file_block_start"].alias("_block"),
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of pieces of one split, each piece with the brace that the reader dropped."""
    place, held, size, number = None, [], 0, 0

    def done() -> pa.RecordBatch:
        names = [x.split()[0] for x in _CHUNKS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        row = [*place, number, b"}".join([*held, b""])]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    for batch in batches:
        values = batch.column("value").to_pylist()
        file, block = batch.column("_file").dictionary_encode().indices.to_numpy(), batch.column("_block").to_numpy()
        starts = np.flatnonzero((np.diff(file, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0)).tolist()
        for a, b in zip(starts, [*starts[1:], len(values)], strict=True):
            own = [batch.column(c)[a].as_py() for c in ("_file", "source", "_size", "_block")]
            if own != place:
                if held:
                    yield done()
                place, held, size, number = own, [], 0, 0
            for value in values[a:b]:
                held.append(value)
                size += len(value) + 1
                if size >= CHUNK:
                    yield done()
                    held, size, number = [], 0, number + 1
    if held:
        yield done()


def _structure(data: np.ndarray, quoted: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets outside strings, the change of depth up to each, and the number of quotes, ``quoted`` of them before."""
    slash = np.flatnonzero(data == ord("\\"))
    run = np.maximum.accumulate(np.where(np.diff(slash, prepend=-2) != 1, np.arange(len(slash)), 0))
    escaped = slash[(np.arange(len(slash)) - run) % 2 == 0] + 1
    quotes = np.setdiff1d(np.flatnonzero(data == ord('"')), escaped, assume_unique=True)
    marks = np.flatnonzero(_STEP[data])
    # a piece ends at its brace, whatever stands before it
    marks = marks[(data[marks] == ord("}")) | ~np.isin(marks, escaped, assume_unique=True)]
    marks = marks[(np.searchsorted(quotes, marks) + quoted) % 2 == 0]
    return marks, np.cumsum(_STEP[data[marks]]), len(quotes)


def _bytes(whole: bytes, is_open: bool) -> np.ndarray:
    """The bytes of a chunk, without the brace that the file's last piece does not have."""
    data = np.frombuffer(whole, np.uint8)
    return data[:-1] if is_open else data


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk: its quotes, its change of depth outside and inside a string, and whether its first character opens an array."""
    for batch in batches:
        rows = []
        for whole in batch.column("data").to_pylist():
            data = np.frombuffer(whole, np.uint8)
            (_, outside, quotes), (_, inside, _) = _structure(data, 0), _structure(data, 1)
            filled = data[~_BLANK[data] & (data != ord("}"))][:1]
            rows.append((len(data), quotes, int(outside[-1]) if len(outside) else 0, int(inside[-1]) if len(inside) else 0, bool(filled[0] == ord("[")) if len(filled) else None))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.bool_()]
        sums = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in (*_KEY, "_size")] + sums, [*_KEY, "_size", "_bytes", "_quotes", "_outside", "_inside", "_array"])


def _ends(data: np.ndarray, quoted: int, depth: int, array: bool | None) -> np.ndarray:
    """Where elements end, each after its brace."""
    if array is None:
        return np.empty(0, dtype=np.int64)
    marks, change, _ = _structure(data, quoted)
    return marks[(data[marks] == ord("}")) & (depth + change == int(array))] + 1


_STATE = ["_quoted", "_depth", "_array", "_open"]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk: the elements that end in it, and its text before the first end and after the last."""
    for batch in batches:
        count, head, tail = [], [], []
        for whole, quoted, depth, array, is_open in zip(*(batch.column(c).to_pylist() for c in ("data", *_STATE)), strict=True):
            data = _bytes(whole, is_open)
            ends = _ends(data, quoted, depth, array)
            count.append(len(ends))
            head.append(data[: ends[0]].tobytes() if len(ends) else data.tobytes())
            tail.append(data[ends[-1] :].tobytes() if len(ends) else b"")
        own = [*_KEY, "source", *_STATE]
        found = [pa.array(count, pa.int64()), pa.array(head, pa.binary()), pa.array(tail, pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in own] + found, [*own, "_ends", "_head", "_tail"])


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements that begin and end in a chunk, after its first end."""
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("data", "source", *_STATE, "_ended")), strict=True):
            whole, source, quoted, depth, array, is_open, ended = row
            data = _bytes(whole, is_open)
            ends = _ends(data, quoted, depth, array)
            if len(ends) < 2:
                continue
            n = len(ends) - 1
            texts = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
            position = pa.array(ended + 1 + np.arange(n), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.repeat(source, n), position, pa.repeat(array, n), texts], ["source", "position", "_array", "text"])


def document_elements(spark: SparkSession, path: str) -> DataFrame:
    """source, position, value, whole: the objects of each file's top array, or its top objects, in file order from 0.

    A text that follows the last whole object, other than the closing bracket of the array, is a row of its own with ``whole``
    false: a document that breaks off keeps all objects before the break. Items that are no objects stand, as text, before the
    next object, which then is no valid JSON. Blank and empty files and empty arrays give no rows. An object must fit a task.
    """
    def kept(df: DataFrame, label: str) -> DataFrame:
        at = scratch_path(spark, label)
        df.write.parquet(at)
        return spark.read.parquet(at)

    chunks = kept(_pieces(spark, path).mapInArrow(_packed, _CHUNKS), "json-chunks")
    sums = kept(chunks.mapInArrow(_sums, "_file string, _block long, _chunk long, _size long, _bytes long, _quotes long, _outside long, _inside long, _array boolean"), "json-sums")
    file, order = Window.partitionBy("_file"), [F.col("_block"), F.col("_chunk")]
    before = file.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = file.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    state = sums.select(
        *_KEY, "_outside", "_inside", (F.coalesce(F.sum("_quotes").over(before), F.lit(0)) % 2).alias("_quoted"),
        F.first("_array", ignorenulls=True).over(whole).alias("_array"),
        # the reader drops the brace that ends a piece; sizes tell whether the last piece had one
        ((F.sum("_bytes").over(whole) > F.col("_size")) & (F.row_number().over(file.orderBy(*order)) == F.count(F.lit(1)).over(whole))).alias("_open"),
    )
    change = F.when(F.col("_quoted") == 0, F.col("_outside")).otherwise(F.col("_inside"))
    state = state.withColumn("_depth", F.coalesce(F.sum(change).over(before), F.lit(0))).select(*_KEY, *_STATE)
    kinds = "_file string, _block long, _chunk long, source string, _quoted long, _depth long, _array boolean, _open boolean"
    edges = kept(chunks.join(small_side(state), _KEY).mapInArrow(_edges, f"{kinds}, _ends long, _head binary, _tail binary"), "json-edges")

    ended = F.coalesce(F.sum("_ends").over(before), F.lit(0)).alias("_ended")
    state = edges.select(*_KEY, *_STATE, "_ends", ended)
    inner = chunks.join(small_side(state.where("_ends > 1")), _KEY).mapInArrow(_inner, "source string, position long, _array boolean, text binary")
    inner = inner.select("source", "position", "_array", F.col("text").cast("string").alias("text"), F.lit(True).alias("whole"))

    part = lambda position, text, whole: F.struct(position.alias("position"), text.alias("text"), whole.alias("whole"))
    known, some = F.col("_array").isNotNull(), F.col("_ends") > 0
    head = part(F.when(known, F.col("_ended")), F.col("_head"), F.when(known, some))
    tail = part(F.when(known, F.col("_ended") + F.col("_ends")), F.col("_tail"), F.lit(False))
    parts = F.array(F.when(F.length("_head") > 0, head), F.when(F.length("_tail") > 0, tail))
    cut = edges.select("*", ended).select("_file", "source", "_block", "_chunk", "_array", F.explode(F.array_compact(parts)).alias("_part"))
    piece = F.struct("_block", "_chunk", F.col("_part.text").alias("text"))
    cut = cut.groupBy("_file", "source", F.col("_part.position").alias("position")).agg(
        F.array_sort(F.collect_list(piece)).alias("_texts"), F.bool_or("_part.whole").alias("whole"), F.first("_array").alias("_array")
    )
    joined = F.array_join(F.transform("_texts", lambda p: p["text"].cast("string")), "")
    cut = cut.select("source", "position", "_array", joined.alias("text"), "whole")

    rows, is_array = inner.unionByName(cut), F.col("_array")
    lead = F.when((F.col("position") == 0) & is_array, r"^\s*\[\s*").when(is_array, r"^\s*,\s*").otherwise(r"^\s+")
    value = F.regexp_replace(F.regexp_replace("text", lead, F.lit("")), r"\s+\z", "")
    tail = F.regexp_replace("text", r"\s+", "")
    blank = F.when(is_array, tail.isin("", "]", "[]")).otherwise(tail == "")
    value = F.when(value == "", tail).otherwise(value)
    return rows.withColumn("value", value).where(F.col("whole") | ~blank).select("source", "position", "value", "whole")


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Event records of large JSON documents; an element that is no valid JSON keeps its text and an error mark."""
    return wrapped(document_elements(spark, path).withColumn("raw", json_fields(F.col("value"))))
