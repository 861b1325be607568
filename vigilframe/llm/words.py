"""Words of whole texts: native expressions, and hashes of words and shingles computed over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is a run of characters other than these six.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SHINGLE = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
# Bytes of text that are hashed at a time; the working memory is about 60 times this.
CHUNK_BYTES = 1 << 18


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS[1:], " " * (len(SPACE_CHARS) - 1))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * _SHINGLE[0]
    h = (h ^ (h >> np.uint64(27))) * _SHINGLE[1]
    return h ^ (h >> np.uint64(31))


def range_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the sequence ``values[begin[i]:end[i]]`` for each i, wherever it stands."""
    powers = np.full(len(values) + 1, _BASE, dtype=np.uint64)
    inverse = np.full(len(values) + 1, _BASE_INVERSE, dtype=np.uint64)
    powers[0] = inverse[0] = 1
    np.cumprod(powers, out=powers)
    np.cumprod(inverse, out=inverse)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(mix(values, seed) * powers[:-1], out=sums[1:])
    return mix((sums[end] - sums[begin]) * inverse[begin] ^ (end - begin).astype(np.uint64), seed)


@dataclass
class Words:
    """Words of some consecutive texts: byte range, text number and hash of each; ``first`` marks each text's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray
    sums: np.ndarray
    inverse: np.ndarray

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """Hash of each word, or of its first ``longest`` bytes."""
        end = self.end if longest is None else np.minimum(self.end, self.start + longest)
        raw = (self.sums[end] - self.sums[self.start]) * self.inverse[self.start]
        return mix(raw ^ ((end - self.start).astype(np.uint64) << np.uint64(48)))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes of UTF-8 stay."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    data = data[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if lower:
        data = lowered(data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    borders = offsets[:-1][offsets[:-1] < len(data)]
    before[borders] = False  # a word ends with its text
    start = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[borders[borders > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    powers = np.full(len(data) + 1, _BASE, dtype=np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
    inverse = np.full(len(data) + 1, _BASE_INVERSE, dtype=np.uint64)
    inverse[0] = 1
    np.cumprod(inverse, out=inverse)
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first, sums, inverse)


def text_chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows that hold about ``size`` bytes; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, data, offsets[row : stop + 1]
        row = stop


def shingles(words_: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of ``width``-word shingles, text by text, and where each text's begin.

    A text with fewer words has its whole sequence as its one shingle, one without words has none.
    """
    h = words_.hashes()
    counts = np.diff(words_.first)
    n = len(h)
    rolled = h.copy()
    for i in range(1, width):
        shifted = np.zeros(n, dtype=np.uint64)
        shifted[: max(n - i, 0)] = h[i:]
        rolled = mix(rolled, i) + shifted
    rolled = mix(rolled, width)
    place = np.arange(n) - words_.first[words_.text]
    whole = place + width <= counts[words_.text]
    value, text = rolled[whole], words_.text[whole]
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        short = np.empty(len(few), dtype=np.uint64)
        for j, t in enumerate(few):
            v = np.uint64(int(counts[t]))
            for w in h[words_.first[t] : words_.first[t + 1]]:
                v = mix(np.array([v ^ w]), 77)[0]
            short[j] = v
        value, text = np.concatenate([value, short]), np.concatenate([text, few])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[fresh], text[fresh]
    return value, np.searchsorted(text, np.arange(len(counts) + 1))
