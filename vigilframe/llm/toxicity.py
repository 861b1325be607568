"""Toxicity by a factorization machine over hashed terms: linear weights plus learned pairwise interactions of terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.words import mix, text_chunks, words_of

# Terms of a word: the word, and its first 4, 5 and 6 bytes, so that inflected and compounded forms share terms.
PREFIXES = (None, 4, 5, 6)
BITS = 20
# Bound of the labelled rows the model is fitted on, per class: those with the least hash of doc_id.
SAMPLE_PER_CLASS = 4000
# Bounds of the model, counted on the sample: most terms, least texts with a term, least z score of a term or of a pair.
TERMS, LEAST_TEXTS, LEAST_APART = 2048, 5, 6.5
# The terms whose pairs are counted: the most frequent ones.
PAIRED_TERMS = 2048
RANK, ROUNDS, STEP = 8, 150, 0.1
# Decay of linear and of pair weights.
DECAY_W, DECAY_V = 1e-3, 1e-4
THRESHOLD = 0.7


def _terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of texts, text number, term) for every term of every word, repeats included."""
    for _, data, offsets in text_chunks(column):
        found = words_of(data, offsets)
        length = found.end - found.start
        text, term = [], []
        for k, longest in enumerate(PREFIXES):
            has = slice(None) if longest is None else length > longest
            text.append(found.text[has])
            term.append((mix(found.hashes(longest)[has], 31 + k) >> np.uint64(64 - BITS)).astype(np.int32))
        yield len(offsets) - 1, np.concatenate(text), np.concatenate(term)


def _distinct_terms(batches):
    for batch in batches:
        out = []
        for n, text, term in _terms(batch.column("text")):
            both = np.unique(text.astype(np.int64) << BITS | term)
            at = np.searchsorted(both >> BITS, np.arange(n + 1))
            terms = (both & ((1 << BITS) - 1)).astype(np.int32)
            out += [terms[at[i] : at[i + 1]].tobytes() for i in range(n)]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out, pa.binary())], ["label", "terms"])


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>) over the distinct known terms of a text."""

    place: np.ndarray  # of each hashed term among the known ones, -1 if unknown
    bias: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, n: int, text: np.ndarray, term: np.ndarray) -> np.ndarray:
        at = self.place[term]
        known = at >= 0
        both = np.unique(text[known].astype(np.int64) * len(self.w) + at[known]) if len(self.w) else np.zeros(0, np.int64)
        row, col = both // max(1, len(self.w)), both % max(1, len(self.w))
        linear = np.bincount(row, weights=self.w[col], minlength=n)
        square = np.zeros(n)
        for f in range(self.v.shape[1]):
            v = self.v[col, f]
            square += np.bincount(row, weights=v, minlength=n) ** 2 - np.bincount(row, weights=v * v, minlength=n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + square / 2, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(label, text) of at most ``per_class`` labelled documents of each class; the ids are bounded, so the join is a broadcast one."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = None
    for value in (0, 1):
        ids = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = ids if picked is None else picked.union(ids)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("label", "text")


def _dense(sample: list[tuple[int, np.ndarray]], place: np.ndarray, terms: int) -> np.ndarray:
    x = np.zeros((len(sample), terms), dtype=np.float32)
    for row, (_, found) in enumerate(sample):
        at = place[found]
        x[row, at[at >= 0]] = 1
    return x


def _deviance_root(n: np.ndarray, up: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Root of the deviance of ``up`` of ``n`` texts from a rate; like a z score, but it also holds for few texts and extreme rates."""
    share = up / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(share > 0, share * np.log(share / rate), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - rate)), 0)
    return np.sqrt(2 * n * np.maximum(out, 0))


def paired_terms(sample: list[tuple[int, np.ndarray]], total: np.ndarray, up: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(terms, z score of the best pair of each) of the most frequent terms.

    A pair counts by how far the texts that hold both terms differ from what each of its terms alone says, the lesser of the two;
    so a term gains nothing from standing next to one that tells by itself, or next to its own head.
    """
    often = np.argsort(-total, kind="stable")[:PAIRED_TERMS]
    often = np.sort(often[total[often] >= LEAST_TEXTS]).astype(np.int64)
    place = np.full(len(total), -1, dtype=np.int32)
    place[often] = np.arange(len(often), dtype=np.int32)
    both, both_up = np.zeros((len(often), len(often)), np.float32), np.zeros((len(often), len(often)), np.float32)
    for low in range(0, len(sample), 1000):
        part = sample[low : low + 1000]
        x, toxic = _dense(part, place, len(often)), np.array([label == 1 for label, _ in part])
        both += x.T @ x
        both_up += x[toxic].T @ x[toxic]
    rate = (up[often] + share) / (total[often] + 1)
    best = np.zeros(len(often))
    for low in range(0, len(often), 128):
        n, n_up = both[low : low + 128].astype(np.float64), both_up[low : low + 128].astype(np.float64)
        z = np.minimum(_deviance_root(n, n_up, rate[None, :]), _deviance_root(n, n_up, rate[low : low + 128, None]))
        best[low : low + 128] = np.where(n >= LEAST_TEXTS, z, 0).max(axis=1, initial=0)
    return often, best


def fit(sample: list[tuple[int, np.ndarray]], positives: int, negatives: int, seed: int = 7) -> FactorizationMachine:
    """Fit on (label, distinct terms); ``positives`` and ``negatives`` count all labelled rows, so that the sample can be weighted back.

    A term enters if it sets the classes apart by itself or if a pair with another frequent term does (``paired_terms``).
    """
    place = np.full(1 << BITS, -1, dtype=np.int32)
    y = np.array([x for x, _ in sample], dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = (positives + 0.5) / (positives + negatives + 1)
        return FactorizationMachine(place, float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, RANK)))
    up, total = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for label, terms in sample:
        total[terms] += 1
        up[terms] += label
    share, n1 = y.mean(), y.sum()
    n0 = len(y) - n1
    apart = np.abs(up - total * share) / np.sqrt(np.maximum(total * share * (1 - share), 1e-9))
    # A term of nearly every text tells nothing; a term of few texts counts by what it tells.
    apart[total < LEAST_TEXTS] = 0
    often, together = paired_terms(sample, total, up, float(share))
    apart[often] = np.maximum(apart[often], together)
    best = np.argsort(-apart, kind="stable")[:TERMS]
    best = np.sort(best[apart[best] >= LEAST_APART])
    place[best] = np.arange(len(best), dtype=np.int32)
    x = _dense(sample, place, len(best))
    weight = np.where(y == 1, positives / n1, negatives / n0)
    weight = (weight / weight.mean()).astype(np.float32)
    draw = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(best), np.float32), draw.normal(0, 0.01, (len(best), RANK)).astype(np.float32), np.float32(np.log(positives / negatives))
    squares = [np.full_like(w, 1e-6), np.full_like(v, 1e-6), 1e-6]
    for _ in range(ROUNDS):
        xv = x @ v
        z = bias + x @ w + ((xv**2).sum(axis=1) - (x @ (v * v)).sum(axis=1)) / 2
        g = (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)
        back = x.T @ g
        steps = (back + DECAY_W * w, x.T @ (g[:, None] * xv) - back[:, None] * v + DECAY_V * v, float(g.sum()))
        for i, s in enumerate(steps):
            squares[i] = squares[i] + s * s
        w = w - STEP * steps[0] / np.sqrt(squares[0])
        v = v - STEP / 2 * steps[1] / np.sqrt(squares[1])
        bias = bias - STEP * steps[2] / np.sqrt(squares[2])
    return FactorizationMachine(place, float(bias), w.astype(np.float64), v.astype(np.float64))


def trained(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> FactorizationMachine:
    """Fit on a bounded sample of ``labels`` (doc_id, label 0 or 1); class sizes are counted over all labels."""
    sizes = {r["label"]: r["count"] for r in labels.where("doc_id is not null and label in (0, 1)").groupBy("label").count().collect()}
    rows = labelled_sample(docs, labels, per_class).mapInArrow(_distinct_terms, "label int, terms binary").collect()
    rows = sorted(((r["label"], np.frombuffer(r["terms"], np.int32)) for r in rows), key=lambda r: (r[0], r[1].tobytes()))
    return fit(rows, max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0)))


def toxicity_scores(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, score in 0 to 1, predicted (score >= threshold).

    Null, empty and unknown texts get the score of the bias, which is the share of toxic texts in the labels when nothing else is
    known. Whole texts are read; nothing but the text enters the score. A map over the rows, without shuffle.
    """

    def run(batches):
        for batch in batches:
            parts = [model.scores(n, text, term) for n, text, term in _terms(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(doc_id: Column) -> Column:
    """The fold that labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the rows labels may be learned from."""
    return labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("label"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text scores ``threshold`` or more; columns as they are. A null text is kept."""
    model = trained(docs, training_labels(labels))

    @F.pandas_udf("double")
    def score(text):
        parts = [model.scores(n, rows, term) for n, rows, term in _terms(pa.array(text, pa.string()))]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.where(F.col("text").isNull() | (score(F.col("text")) < threshold))
