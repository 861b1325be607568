"""Periodic runs of words: Lyndon arrays of both symbol orders by Baier's grouping, their roots extended to maximal runs.

A run with smallest period ``p`` holds, under one of the two orders of the symbols, a longest Lyndon word of length ``p``. The first
phase of Baier's suffix sorting gathers suffixes by their longest Lyndon prefix, so the lengths of its groups are the Lyndon array.
Each root is extended to both sides as far as the text repeats at its distance; ranks of blocks of doubling length, built as far as
some extension reaches, give these extensions for all roots at once.

Before that, words that cannot be in a run are taken out: in a run of exponent ``e`` each word occurs ``e`` times or more, so a word that
occurs less often in a stretch cuts the stretch in two, again and again. This removes no run and shortens none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.words import bind, words

# Bytes of text searched at a time (a longer text is searched alone), and rounds of cutting at rare words.
CHUNK_BYTES = 1 << 20
CUTS = 12

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def lyndon_lengths(symbols: list[int]) -> list[int]:
    """Length of the longest Lyndon word that begins at each place; an end of the text is below every symbol.

    Suffixes are grouped by first symbol and the groups visited from the highest down. A visited group's word ``u`` follows, some
    number of times, the word of the nearest place to the left that is not visited yet; these places move, by number of repeats and
    by group, into new groups just above their own, whose words end with that many ``u``.
    """
    n = len(symbols)
    places: dict[int, list[int]] = {}
    for i, symbol in enumerate(symbols):
        places.setdefault(symbol, []).append(i)
    members = [places[symbol] for symbol in sorted(places)]
    length = [1] * len(members)
    above, below = list(range(1, len(members) + 1)), list(range(-1, len(members) - 1))
    group = [0] * n
    for g, held in enumerate(members):
        for i in held:
            group[i] = g
    left = list(range(-1, n - 1))
    visited = bytearray(n)
    out = [0] * n
    top = len(members)
    above = [a if a < top else -1 for a in above]
    now = top - 1
    while now >= 0:
        size = length[now]
        here = sorted(i for i in members[now] if group[i] == now)
        members[now] = here
        repeats: dict[int, int] = {}
        for i in here:
            visited[i] = 1
            out[i] = size
        for i in here:
            j = left[i]
            while j >= 0 and visited[j]:
                j = left[j]
            left[i] = j
            if j >= 0:
                repeats[j] = repeats.get(j, 0) + 1
        levels: dict[int, list[int]] = {}
        for j, times in repeats.items():
            levels.setdefault(times, []).append(j)
        for times in sorted(levels, reverse=True):
            made: dict[int, int] = {}
            for j in levels[times]:
                old = group[j]
                new = made.get(old)
                if new is None:
                    new = made[old] = len(members)
                    members.append([])
                    length.append(length[old] + times * size)
                    upper = above[old]
                    above.append(upper)
                    below.append(old)
                    above[old] = new
                    if upper >= 0:
                        below[upper] = new
                members[new].append(j)
                group[j] = new
        now = below[now]
    return out


class Extensions:
    """Longest common extensions between places of a text, from ranks of its blocks of 1, 2, 4, ... symbols."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)]

    def _level(self, k: int) -> np.ndarray:
        while len(self.ranks) <= k:
            half = 1 << (len(self.ranks) - 1)
            rank, count = self.ranks[-1].astype(np.int64), self.n - 2 * half + 1
            if count <= 0:
                self.ranks.append(np.zeros(0, np.int32))
                continue
            pairs = rank[:count] * (rank.max() + 1) + rank[half : half + count]
            self.ranks.append(np.unique(pairs, return_inverse=True)[1].astype(np.int32))
        return self.ranks[k]

    def _same(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the blocks of 2**k symbols at a and at b (b the later one) lie in the text and are equal."""
        rank = self._level(k)
        inside = np.flatnonzero((a >= 0) & (b < len(rank)))
        same = np.zeros(len(a), dtype=bool)
        same[inside] = rank[a[inside]] == rank[b[inside]]
        return same

    def reach(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """Number of equal symbols from a and b (> a) on, or up to just before them."""
        length = np.zeros(len(a), dtype=np.int64)
        alive, k = np.arange(len(a)), 0
        step = lambda which, k: self._same(k, *((x[which] - length[which] - (1 << k)) if back else (x[which] + length[which]) for x in (a, b)))
        while len(alive):
            alive = alive[step(alive, k)]
            length[alive] += 1 << k
            k += 1
        for k in range(k - 1, -1, -1):
            more = step(np.arange(len(a)), k)
            length[more] += 1 << k
        return length


def maximal_runs(symbols: np.ndarray, borders: np.ndarray, exponent: int, least: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of at least ``exponent`` periods and ``least`` symbols.

    ``borders`` marks places between texts: symbols of their own, in no run.
    """
    top = int(symbols.max(initial=0)) + 1
    own = -1 - np.arange(len(symbols), dtype=np.int64)
    roots = []
    for order in (symbols, top - symbols):
        periods = np.array(lyndon_lengths(np.where(borders, own, order).tolist()), dtype=np.int64)
        at = np.flatnonzero(~borders)
        roots.append(np.stack([at, periods[at]], axis=1))
    start, period = np.unique(np.concatenate(roots), axis=0).T
    extensions = Extensions(np.where(borders, own, symbols))
    # Roots without an equal symbol one period on or before repeat nothing.
    rank = extensions.ranks[0]
    again = np.zeros(len(start), dtype=bool)
    ahead = start + period < len(rank)
    again[ahead] = rank[start[ahead]] == rank[(start + period)[ahead]]
    behind = start > 0
    again[behind] |= rank[start[behind] - 1] == rank[(start + period)[behind] - 1]
    start, period = start[again], period[again]
    first = start - extensions.reach(start, start + period, back=True)
    length = start + period + extensions.reach(start, start + period) - first
    keep = (length >= exponent * period) & (length >= least)
    return np.unique(np.stack([first, length, period], axis=1)[keep], axis=0).reshape(-1, 3)


def _stretches(word: np.ndarray, text: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that can be in a run, and the stretch each belongs to."""
    at, stretch = np.arange(len(word)), text
    for _ in range(CUTS):
        if not len(at):
            break
        _, which, often = np.unique(stretch * (int(word.max()) + 1) + word[at], return_inverse=True, return_counts=True)
        keep = often[which] >= exponent
        whole = keep.all()
        at, stretch = at[keep], stretch[keep]
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (np.diff(at) > 1) | (stretch[1:] != stretch[:-1])
        stretch = np.cumsum(fresh) - 1
        long = np.bincount(stretch, minlength=1)[stretch] >= max(exponent, least) if len(at) else fresh
        at, stretch = at[long], stretch[long]
        if whole:
            break
    return at, stretch


def runs_of(texts: list[list[bytes]], exponent: int, least: int) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, by start and period."""
    known: dict[bytes, int] = {}
    word = np.array([known.setdefault(w, len(known)) for text in texts for w in text], dtype=np.int64)
    first = np.cumsum([0, *map(len, texts)])
    at, stretch = _stretches(word, np.repeat(np.arange(len(texts)), np.diff(first)), exponent, least)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(at):
        # One symbol between stretches; it lies at place + number of the stretch.
        shift = np.r_[0, np.cumsum(stretch[1:] != stretch[:-1])]
        place = np.arange(len(at)) + shift
        symbols, origin = np.zeros(place[-1] + 1, dtype=np.int64), np.zeros(place[-1] + 1, dtype=np.int64)
        borders = np.ones(place[-1] + 1, dtype=bool)
        symbols[place], origin[place], borders[place] = word[at], at, False
        rows = maximal_runs(symbols, borders, exponent, least)
        begin = origin[rows[:, 0]]
        owner = np.searchsorted(first, begin, side="right") - 1
        for i in np.lexsort((rows[:, 2], begin)):
            out[owner[i]].append((int(begin[i] - first[owner[i]]), int(rows[i, 1]), int(rows[i, 2])))
    return out


def _collapsed(text: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    if runs:
        gone = np.zeros(len(text) + 1, dtype=np.int64)
        for start, length, period in runs:
            gone[start + period] += 1
            gone[start + length] -= 1
        gone = np.cumsum(gone)
        text = [w for w, g in zip(text, gone.tolist()) if not g]
    return b" ".join(text).decode()


def _searched(exponent: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column("doc_id"), batch.column("text")
            row = 0
            while row < len(batch):
                # bytes.split cuts at the six characters that end a word.
                texts, size, begin = [], 0, row
                while row < len(batch) and (size < CHUNK_BYTES or row == begin):
                    body = (column[row].as_py() or "").encode()
                    texts.append(body.split())
                    size += len(body)
                    row += 1
                runs = runs_of(texts, exponent, least)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(begin, row - begin),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r)) for r in rs] for rs in runs], _RUNS),
                        pa.array([_collapsed(t, rs) for t, rs in zip(texts, runs)], pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return run


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs, collapsed.

    ``docs`` has doc_id (long) and text; further columns are ignored. Words are runs of characters other than blank and 0x09-0x0D,
    numbered from 0. ``runs`` holds every stretch of words with smallest period ``p``, at least ``exponent`` (2 or more) periods and
    ``least`` words that no neighbouring word extends with that period, as structs (start, length, period) by start and period.
    ``collapsed`` is the text with single blanks, without the words that a run holds after its first period. A null or empty text has no
    words, no runs and the collapsed text "". Rows are searched one by one, so ties, repeated rows and null doc_ids stay as they are,
    and an empty table gives an empty result. A text is searched whole, in memory of some hundred times the words left after the cuts.
    """
    if exponent < 2:
        raise ValueError("a run has two periods or more")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_searched(exponent, least), f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")


def longest_by_exponent(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; of equal ones the first by start and period. Null without runs."""
    none = F.lit(None).cast(RUN)
    return F.reduce(runs, none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text; the words of texts whose crc32(doc_id) ends in 0 repeat, from a place on, with a period, both set by the checksum."""
    h = F.crc32(F.col("doc_id").cast("string"))

    def repeated(ws: Column) -> Column:
        n, g = F.size(ws).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, (a + (i - a) % p).cast("int")))), " ")

    changed = F.when(h % 10 == 0, bind(words(F.col("text")), lambda ws: F.when(F.size(ws) > 0, repeated(ws)).otherwise("")))
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))
