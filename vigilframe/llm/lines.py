"""Substring dedup by hashing lines, paragraphs, passages or runs of clauses: the earliest ranked occurrence of a unit stays, the others go."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.words import SPACE_CHARS, WORD_PATTERN, Words, range_hashes, text_chunks, words, words_of
from vigilframe.session import scratch_path

# What separates the units, as pattern and as the text put between kept units.
SEPARATORS = {"line": ("\n", "\n"), "paragraph": ("\n[ \t\r]*\n", "\n\n")}
MIN_WORDS = 5
# Least words of a run of adjacent units, and the characters that end a unit before a blank; a line break always does.
RUN_WORDS = 40
UNIT_ENDS = ".!?,;:"
# Between the sentences of a line.
SENTENCE = "(?<=[.!?])[ \t\r]+"
# Place of a unit of passages: line number times this, and the number of the sentence from 1 (0: the line, or a run that begins there).
LINE = 1 << 31


def normalised(unit: Column) -> Column:
    """Lower case with single blanks."""
    return F.trim(F.regexp_replace(F.lower(unit), r"[\x20\x09-\x0D]+", " "))


def passages(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, _key, place, _unit: lines, the sentences of lines that have several, and runs of lines that are all under ``min_words`` words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("_key"), F.split(text, "\n").alias("_lines"))
    # One letter a line: s is short.
    rows = rows.withColumn("_size", F.array_join(F.transform("_lines", lambda x: F.when(F.size(words(x)) < min_words, "s").otherwise("l")), ""))
    size, lines = F.col("_size"), F.col("_lines")
    begins = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: (F.substr(size, i, F.lit(2)) == "ss") & ((i == 1) | (F.substr(size, i - 1, F.lit(1)) == "l")))
    run = lambda i: F.array_join(F.slice(lines, i, F.length(F.regexp_extract(F.substr(size, i), "^s+", 0))), "\n")
    runs = F.when(size.contains("ss"), F.transform(begins, lambda i: F.struct((i - 1).alias("line"), run(i).alias("text"), F.lit(True).alias("run"))))
    single = F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("text"), F.lit(False).alias("run")))
    rows = rows.select("doc_id", "_key", F.explode(F.concat(single, F.coalesce(runs, F.slice(single, 1, 0)))).alias("_u"))
    rows = rows.withColumn("_parts", F.when(F.col("_u.run"), F.array()).otherwise(F.split("_u.text", SENTENCE)))
    units = F.when(F.size("_parts") > 1, F.concat(F.array("_u.text"), "_parts")).otherwise(F.array("_u.text"))
    rows = rows.select("doc_id", "_key", "_u.line", F.posexplode(units).alias("_part", "_unit"))
    return rows.select("doc_id", "_key", (F.col("line").cast("long") * LINE + F.col("_part")).alias("place"), "_unit")


def repeated_units(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """(_key, place) of every unit of ``docs`` that is not the earliest of its digest; _key is ``row_key``.

    Units under ``min_words`` words never count as repeated. Rank is (doc_id, place), a null doc_id last. Digests are 128 bits.
    Only digests and places are shuffled, counts are combined before the shuffle, and the join back is an equi-join whose hot
    digests adaptive execution splits.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    if unit == "passage":
        rows = passages(docs, min_words)
    else:
        rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("_key"), F.posexplode(F.split(text, SEPARATORS[unit][0])).alias("place", "_unit"))
    rows = rows.where(F.size(words(F.col("_unit"))) >= min_words)
    form = normalised(F.col("_unit"))
    rows = rows.select("doc_id", "_key", "place", F.xxhash64(form).alias("_d1"), F.xxhash64(F.lit(7), form).alias("_d2"))
    rank = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("id"), F.col("place").alias("place"), F.col("_key").alias("key"))
    first = rows.groupBy("_d1", "_d2").agg(F.min(rank).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    again = rows.join(first, ["_d1", "_d2"])
    same = (F.col("_key") == F.col("_first.key")) & (F.col("place") == F.col("_first.place"))
    return again.where(~same).select("_key", "place")


def unit_runs(w: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end (word numbers) of the shortest run of whole units with ``least`` words or more from each unit on."""
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.r_[0, np.cumsum(w.data == 10)]
    ends = np.isin(w.data[w.end - 1], np.frombuffer(UNIT_ENDS.encode(), np.uint8))
    ends[:-1] |= breaks[w.start[1:]] > breaks[w.end[:-1]]
    ends[:-1] |= w.text[1:] != w.text[:-1]
    ends[-1] = True
    stop = np.flatnonzero(ends) + 1
    begin = np.r_[0, stop[:-1]]
    found = np.searchsorted(stop, begin + least)
    whole = found < len(stop)
    begin, end = begin[whole], stop[found[whole]]
    inside = end <= w.first[w.text[begin] + 1]
    return begin[inside], end[inside]


def _runs(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column("text")):
                w = words_of(data, offsets)
                begin, end = unit_runs(w, least)
                text, h = w.text[begin], w.hashes()
                d1, d2 = range_hashes(h, begin, end, 1), range_hashes(h, begin, end, 2)
                order = np.lexsort((begin, d2, d1, text))
                again = np.zeros(len(order), dtype=bool)
                same = [x[order][1:] == x[order][:-1] for x in (text, d1, d2)]
                again[order[1:]] = same[0] & same[1] & same[2]
                at = pa.array(row + text)
                place, stop = begin - w.first[text], end - w.first[text]
                columns = [batch.column(c).take(at) for c in ("_rank", "_a", "_b")]
                columns += [pa.array(x) for x in (place.astype(np.int32), stop.astype(np.int32), d1.view(np.int64), d2.view(np.int64), again)]
                yield pa.RecordBatch.from_arrays(columns, ["_rank", "_a", "_b", "place", "stop", "_d1", "_d2", "again"])

    return run


def repeated_runs(docs: DataFrame, least: int = RUN_WORDS) -> DataFrame:
    """(_key, place, stop): word ranges of runs of adjacent units that stand in a text of a smaller doc_id, or earlier in the same text.

    Units are what lines and the marks in ``UNIT_ENDS`` before a blank set apart; a run is the least number of units, from one on, that hold
    ``least`` words. Runs are equal if their words are, A-Z lower-cased; they are grouped by digests of 128 bits. A null doc_id ranks last,
    and texts of one doc_id rank alike. A text sends each of its runs once, digests only; counts are combined before the shuffle.
    """
    key = row_key(F.col("doc_id"), F.col("text"))
    rows = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("_rank"), key["a"].alias("_a"), key["b"].alias("_b"), "text")
    rows = rows.mapInArrow(_runs(least), "_rank long, _a long, _b long, place int, stop int, _d1 long, _d2 long, again boolean")
    named = F.struct(F.col("_a").alias("a"), F.col("_b").alias("b")).alias("_key")
    fresh = rows.where("not again")
    path = scratch_path(docs.sparkSession, "repeated-runs")
    fresh.groupBy("_d1", "_d2").agg(F.min("_rank").alias("_first"), F.max("_rank").alias("_last")).where("_first < _last").drop("_last").write.parquet(path)
    first = docs.sparkSession.read.parquet(path)
    # The share of repeated runs is the same at every size, so the plan is too.
    later = fresh.join(first.hint("merge"), ["_d1", "_d2"]).where("_rank > _first")
    return later.select(named, "place", "stop").unionByName(rows.where("again").select(named, "place", "stop"))


def _cut_runs():
    word = re.compile(WORD_PATTERN)

    @F.pandas_udf("text string, spans array<struct<begin: int, end: int>>")
    def cut(text: pd.Series, removed: pd.Series) -> pd.DataFrame:
        rows = []
        for body, runs in zip(text, removed, strict=True):
            if body is None or runs is None:
                rows.append((None, None))
                continue
            at = [m.span() for m in word.finditer(body)]
            spans, until = [], -1
            for run in sorted((r["place"], r["stop"]) for r in runs):
                if run[0] <= until:
                    if run[1] > until:
                        spans[-1]["end"] = at[run[1] - 1][1]
                else:
                    spans.append({"begin": at[run[0]][0], "end": at[run[1] - 1][1]})
                until = max(until, run[1])
            kept, begin = [], 0
            for s in spans:
                kept.append(body[begin : s["begin"]])
                begin = s["end"]
            rows.append(("".join([*kept, body[begin:]]), spans))
        return pd.DataFrame(rows, columns=["text", "spans"])

    return cut


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that name a row by its id and text; equal rows have equal keys."""
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit(11), doc_id, text).alias("b"))


def _cut_passages(min_words: int):
    sentence, word = re.compile(SENTENCE), re.compile(WORD_PATTERN)

    def cut_one(body: str, gone: set[int]) -> tuple[str, list[dict]]:
        lines, kept, spans, at, run = body.split("\n"), [], [], 0, False
        short = [len(word.findall(x)) < min_words for x in lines]
        for i, line in enumerate(lines):
            end = at + len(line)
            if short[i]:
                starts = not (i and short[i - 1])
                run = i * LINE in gone if starts else run
                if run and starts:
                    spans.append({"begin": at, "end": end})
                elif run:
                    spans[-1]["end"] = end
                else:
                    kept.append(line)
            elif i * LINE in gone:
                spans.append({"begin": at, "end": end})
            else:
                ends = [(m.start(), m.end()) for m in sentence.finditer(line)] + [(len(line), len(line))]
                stays, begin, cut = [], 0, False
                for j, (stop, after) in enumerate(ends, 1):
                    cut = len(ends) > 1 and i * LINE + j in gone
                    if cut:
                        spans.append({"begin": at + begin, "end": at + stop})
                    else:
                        stays.append(line[begin:after])
                    begin = after
                rest = "".join(stays)
                if len(stays) == len(ends) or rest.strip(SPACE_CHARS):
                    kept.append(rest.rstrip(" \t\r") if cut else rest)
            at = end + 1
        return "\n".join(kept), spans

    @F.pandas_udf("text string, spans array<struct<begin: int, end: int>>")
    def cut(text: pd.Series, removed: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if body is None or places is None else cut_one(body, set(places)) for body, places in zip(text, removed, strict=True)]
        return pd.DataFrame(rows, columns=["text", "spans"])

    return cut


def _gone(docs: DataFrame, unit: str, min_words: int) -> DataFrame:
    """(_key, removed): what is to be cut from each text, in the form that ``_cut`` takes."""
    if unit == "run":
        return repeated_runs(docs, min_words).groupBy("_key").agg(F.collect_set(F.struct("place", "stop")).alias("removed"))
    return repeated_units(docs, unit, min_words).distinct().groupBy("_key").agg(F.collect_list("place").alias("removed"))


def _cut(unit: str, min_words: int):
    if unit == "run":
        return _cut_runs()
    if unit == "passage":
        return _cut_passages(min_words)
    pattern, between = SEPARATORS[unit]
    separator = re.compile(pattern)

    @F.pandas_udf("text string, spans array<struct<begin: int, end: int>>")
    def cut(text: pd.Series, removed: pd.Series) -> pd.DataFrame:
        rows = []
        for body, places in zip(text, removed, strict=True):
            if body is None or places is None:
                rows.append((None, None))
                continue
            gone, kept, spans, at = set(places), [], [], 0
            ends = [(m.start(), m.end()) for m in separator.finditer(body)] + [(len(body), len(body))]
            for place, (end, after) in enumerate(ends):
                if place in gone:
                    spans.append({"begin": at, "end": end})
                else:
                    kept.append(body[at:end])
                at = after
            rows.append((between.join(kept), spans))
        return pd.DataFrame(rows, columns=["text", "spans"])

    return cut


def without_repeats(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, original (the text as it was), text (what stays), spans.

    ``spans`` holds [begin, end) of each removed unit in code points of the original text, separators left out, empty if none.
    Equal rows (same doc_id and text) rank alike: what goes from one goes from all. A null text stays null. The text that stays
    joins the kept units by a line break (lines) or a blank line (paragraphs); a text without repeats is not touched. Further
    columns are ignored. The unit "passage" cuts repeated lines, repeated sentences inside lines that stay, and repeated runs of
    lines under ``min_words`` words; a line that loses all its sentences goes with its break. The unit "run" cuts repeated runs of adjacent
    units (``repeated_runs``) of ``min_words`` words or more and nothing else: overlapping and adjacent ones as one span from the first
    word to the last; the blanks around it stay.
    """
    docs = docs.select("doc_id", "text")
    gone = _gone(docs, unit, min_words).withColumnRenamed("removed", "_removed")
    joined = docs.withColumn("_key", row_key(F.col("doc_id"), F.col("text"))).join(gone, "_key", "left")
    # Only texts with something to remove go to Python.
    joined = joined.withColumn("_cut", _cut(unit, min_words)(F.when(F.col("_removed").isNotNull(), F.col("text")), F.col("_removed")))
    return joined.select(
        "doc_id", F.col("text").alias("original"),
        F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.col("_cut.text")).alias("text"),
        F.coalesce("_cut.spans", F.array().cast("array<struct<begin: int, end: int>>")).alias("spans"),
    )


def deduplicated(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated units cut from text; a document that loses its last word goes. n_chars, if there, follows the text.

    Columns are kept by packing the row, so no name can clash.
    """
    gone = _gone(docs, unit, min_words)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("_key", row_key(F.col("row.doc_id"), F.col("row.text"))).join(gone, "_key", "left")
    cut = F.col("removed").isNotNull()
    rows = rows.withColumn("kept", _cut(unit, min_words)(F.when(cut, F.col("row.text")), F.col("removed"))["text"])
    rows = rows.where(~cut | (F.size(words(F.col("kept"))) > 0))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return rows.select(*[(F.when(cut, new[c]).otherwise(F.col("row")[c]) if c in new else F.col("row")[c]).alias(c) for c in docs.columns])
