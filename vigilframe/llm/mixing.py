"""Soft-membership mixing: posteriors of domains, and document rates whose expected domain tokens match target weights."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.words import mix, text_chunks, words_of
from vigilframe.session import scratch_path

DOMAINS = ("clean", "junk", "toxic")
TARGETS = {"clean": 0.97, "junk": 0.02, "toxic": 0.01}
BITS = 18
# Bound of the labelled rows per domain that the classifier is fitted on; terms it uses; least sample texts with such a term.
SAMPLE_PER_DOMAIN, TERMS, LEAST_TEXTS = 2000, 1024, 4
ROUNDS, STEP, DECAY = 120, 0.1, 1e-4
# The fit of rates ends at this residual, relative to the total, or at the proven minimum. It opens with a few plain gradient passes.
TOLERANCE, PASSES, OPENING = 1e-5, 40, 6
# Weight of staying near the rates of the opening; share of the sum of squares that a proven minimum may be off; lengths of a move tried at once.
NEARNESS, GAP, LENGTHS = 1e-7, 1e-5, 3.0 ** np.arange(2, -18, -1)


def _terms(column: pa.Array):
    """(number of texts, words of each, text and hashed term pairs): words, their heads and tails, and shares of distinct words and length."""
    for _, data, offsets in text_chunks(column):
        found = words_of(data, offsets, lower=False)
        n, counts = len(offsets) - 1, np.diff(found.first)
        whole = found.hashes()
        tail = np.maximum(found.start, found.end - 2)
        tails = mix((found.sums[found.end] - found.sums[tail]) * found.inverse[tail], 5)
        pieces = [whole, mix(found.hashes(4), 1), mix(found.hashes(5), 2), tails]
        distinct = np.unique(np.stack([found.text.astype(np.uint64), whole]), axis=1)[0] if len(whole) else np.zeros(0, np.uint64)
        share = np.bincount(distinct.astype(np.int64), minlength=n) * 10 // np.maximum(counts, 1)
        size = np.frexp(counts.astype(float))[1]
        pieces += [mix((share + 1000).astype(np.uint64), 3), mix((size + 2000).astype(np.uint64), 4)]
        text = np.concatenate([found.text] * 4 + [np.arange(n)] * 2)
        yield n, counts, text, (np.concatenate(pieces) >> np.uint64(64 - BITS)).astype(np.int64)


def _distinct_terms(batches):
    for batch in batches:
        out = []
        for n, _, text, term in _terms(batch.column("text")):
            both = np.unique(text << BITS | term)
            at = np.searchsorted(both >> BITS, np.arange(n + 1))
            terms = (both & ((1 << BITS) - 1)).astype(np.int32)
            out += [terms[at[i] : at[i + 1]].tobytes() for i in range(n)]
        yield pa.RecordBatch.from_arrays([batch.column("domain"), pa.array(out, pa.binary())], ["domain", "terms"])


@dataclass
class DomainModel:
    """Softmax regression over the presence of known terms."""

    place: np.ndarray
    bias: np.ndarray
    w: np.ndarray

    def posteriors(self, n: int, text: np.ndarray, term: np.ndarray) -> np.ndarray:
        at = self.place[term]
        known = at >= 0
        width = max(1, len(self.w))
        both = np.unique(text[known] * width + at[known])
        z = np.stack([np.bincount(both // width, weights=self.w[both % width, c], minlength=n) if len(both) else np.zeros(n) for c in range(len(self.bias))], axis=1)
        z = z + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit_domains(sample: list[tuple[int, np.ndarray]], sizes: np.ndarray) -> DomainModel:
    """Fit on (domain number, distinct terms); ``sizes`` counts all labelled rows of each domain."""
    place = np.full(1 << BITS, -1, dtype=np.int64)
    prior = (sizes + 0.5) / (sizes + 0.5).sum()
    if not sample:
        return DomainModel(place, np.log(prior), np.zeros((0, len(sizes))))
    y = np.array([d for d, _ in sample])
    counts = np.zeros((len(sizes), 1 << BITS))
    for domain, terms in sample:
        counts[domain, terms] += 1
    total, apart = counts.sum(axis=0), np.zeros(1 << BITS)
    for c in np.unique(y):
        share = (y == c).mean()
        z = (counts[c] - total * share) ** 2 / np.maximum(total * share * (1 - share), 1e-9)
        apart = np.maximum(apart, z)
    apart[total < LEAST_TEXTS] = 0
    best = np.sort(np.argsort(-apart, kind="stable")[:TERMS])
    best = best[apart[best] > 9]
    place[best] = np.arange(len(best))
    x = np.zeros((len(y), len(best) + 1), dtype=np.float32)
    x[:, -1] = 1
    for row, (_, terms) in enumerate(sample):
        at = place[terms]
        x[row, at[at >= 0]] = 1
    drawn = np.bincount(y, minlength=len(sizes))
    weight = np.where(drawn > 0, sizes / np.maximum(drawn, 1), 0)[y]
    weight = (weight / weight.sum()).astype(np.float32)
    goal = np.eye(len(sizes), dtype=np.float32)[y]
    w, square = np.zeros((x.shape[1], len(sizes)), np.float32), np.full((x.shape[1], len(sizes)), 1e-8, np.float32)
    w[-1] = np.log(prior)
    for _ in range(ROUNDS):
        z = x @ w
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = x.T @ (weight[:, None] * (e / e.sum(axis=1, keepdims=True) - goal)) + DECAY * w
        square += g * g
        w -= STEP * g / np.sqrt(square)
    return DomainModel(place, w[-1].astype(float), w[:-1].astype(float))


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic, else junk where quality is 0, else clean; rows without a full label give none."""
    kind = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(kind).alias("domain")).where("domain is not null")


def trained(docs: DataFrame, domains: DataFrame, count: int, per_domain: int = SAMPLE_PER_DOMAIN) -> DomainModel:
    """The classifier, from at most ``per_domain`` labelled documents of each domain (those with the least hash of doc_id)."""
    sizes = np.zeros(count)
    for r in domains.groupBy("domain").count().collect():
        sizes[r["domain"]] = r["count"]
    picked = None
    for c in range(count):
        ids = domains.where(F.col("domain") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_domain)
        picked = ids if picked is None else picked.union(ids)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("domain", "text").mapInArrow(_distinct_terms, "domain int, terms binary").collect()
    return fit_domains(sorted(((r["domain"], np.frombuffer(r["terms"], np.int32)) for r in rows), key=lambda r: (r[0], r[1].tobytes())), sizes)


def with_posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, n_words and the posteriors p of each row."""

    def run(batches):
        for batch in batches:
            counts, p = [np.zeros(0, np.int64)], [np.zeros((0, len(model.bias)))]
            for n, words, text, term in _terms(batch.column("text")):
                counts.append(words.astype(np.int64))
                p.append(model.posteriors(n, text, term))
            flat = np.concatenate(p)
            offsets = pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(counts)), pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))], ["doc_id", "n_words", "p"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, p array<double>")


def _rates(p: np.ndarray, steps: list[np.ndarray], most: float | None) -> np.ndarray:
    """Every row starts at rate 1 and repeats the steps of all passes so far: a move along its posteriors, then onto [0, most]."""
    rate = np.ones(len(p))
    for s in steps:
        rate = np.clip(rate - p @ s, 0, most)
    return rate


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def fitted_steps(known: DataFrame, targets: np.ndarray, most: float | None = None, passes: int = PASSES) -> list[np.ndarray]:
    """Steps of the projected gradient on sum over domains of (expected tokens - target)^2 / present tokens.

    A pass is one job that sends back one sum per domain and task; rows repeat all steps, so nothing is kept between passes.
    """
    width = len(targets)

    def sums(steps, gram):
        def run(batches):
            total = np.zeros((width, width)) if gram else np.zeros(width)
            for batch in batches:
                p, n = _matrix(batch.column("p"), width), batch.column("n_words").to_numpy()
                total = total + ((p * n[:, None]).T @ p if gram else (n * _rates(p, steps, most)) @ p)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["s"])

        rows = known.select("n_words", "p").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("c", "x")).groupBy("c").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(width * width if gram else width)
        for r in rows:
            out[r["c"]] = r["x"]
        return out

    inner = sums([], True).reshape(width, width)
    present = np.maximum(sums([], False), 1e-6)
    scale = np.sqrt(present)
    speed = 1 / max(np.linalg.eigvalsh(inner / np.outer(scale, scale)).max(), 1e-9)
    steps: list[np.ndarray] = []
    for _ in range(passes):
        off = sums(steps, False) - targets
        if np.abs(off).sum() <= TOLERANCE * max(targets.sum(), 1):
            break
        steps.append(speed * off / present)
    return steps


@dataclass
class Fit:
    """Steps that give every row its rate; the expected tokens they leave off target, and why the fit ended."""

    steps: list[np.ndarray]
    expected: np.ndarray
    residual: float
    reached: bool
    passes: int


def fitted(known: DataFrame, targets: np.ndarray, most: float | None = None) -> Fit:
    """Rates whose expected tokens meet ``targets``, or come as near as rates within [0, most] can.

    A few projected-gradient passes give rates x0. The rest is one last projected step, x = clip(x0 - p.u, 0, most), with u the
    multipliers of the least-squares problem plus ``NEARNESS`` times the words-weighted distance from x0. Its dual is concave and
    has one unknown a domain; Newton solves it on the summed Gram matrix of the rows that are not at a bound. A pass is one job
    that tries all ``LENGTHS`` of the move at once and sends back some sums per task, so there is no search loop on the driver.
    It ends when the targets are met (``reached``), or when the gap between problem and dual, which the slope of the dual gives,
    proves the sum of squares to be within ``GAP`` of its minimum: then ``residual``, relative to all target words, is what no
    rates can mend. There is no cap on the passes: each must raise the dual, which is bounded.
    """
    width, reach = len(targets), 1.0
    opening = fitted_steps(known, targets, most, OPENING)
    total = max(targets.sum(), 1.0)

    def sums(tries: np.ndarray) -> np.ndarray:
        """Per try: distance and linear part of the dual, present and expected tokens, Gram matrix of the free rows."""

        def run(batches):
            out = np.zeros((len(tries), 1 + 2 * width + width * width))
            for batch in batches:
                p, n = _matrix(batch.column("p"), width), batch.column("n_words").to_numpy().astype(float)
                start, present = _rates(p, opening, most), n @ p
                for t, u in enumerate(tries):
                    pull = p @ u
                    aim = start - pull
                    rate = np.clip(aim, 0, most)
                    inside = (aim > 0) & (aim < (np.inf if most is None else most))
                    free = p[inside]
                    out[t, 0] += n @ (0.5 * (rate - start) ** 2 + pull * rate)
                    out[t, 1 : 1 + width] += present
                    out[t, 1 + width : 1 + 2 * width] += (n * rate) @ p
                    out[t, 1 + 2 * width :] += ((free * n[inside, None]).T @ free).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], ["s"])

        rows = known.select("n_words", "p").mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("c", "x")).groupBy("c").agg(F.sum("x").alias("x")).collect()
        out = np.zeros(len(tries) * (1 + 2 * width + width * width))
        for r in rows:
            out[r["c"]] = r["x"]
        return out.reshape(len(tries), -1)

    def dual(u: np.ndarray, row: np.ndarray) -> float:
        return row[0] - u @ targets - 0.5 * NEARNESS * (scale * u) @ u

    u, row = np.zeros(width), sums(np.zeros((1, width)))[0]
    scale, passes = np.maximum(row[1 : 1 + width], 1e-6), len(opening) + 1
    while True:
        expected = row[1 + width : 1 + 2 * width]
        off = expected - targets
        residual = np.abs(off).sum() / total
        slope = off - NEARNESS * scale * u
        if residual <= TOLERANCE or slope @ (slope / scale) <= GAP * (off @ (off / scale)):
            break
        move = np.linalg.solve(row[1 + 2 * width :].reshape(width, width) + np.diag(NEARNESS * scale), slope)
        tries = u + reach * LENGTHS[:, None] * move
        if np.allclose(tries, u, rtol=1e-14, atol=0):
            break  # the precision of the numbers
        rows, passes = sums(tries), passes + 1
        values = [dual(t, r) for t, r in zip(tries, rows, strict=True)]
        best = int(np.argmax(values))
        if values[best] > dual(u, row):
            u, row, reach = tries[best], rows[best], 1.0
        else:
            reach *= LENGTHS[-1]
    return Fit([*opening, u], expected, float(residual), bool(residual <= TOLERANCE), passes)


def _uniform(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(23), doc_id), F.lit(1 << 30)) / F.lit(float(1 << 30))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None, most: float | None = None, thin: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, p_<domain> of each, rate, copies, residual, reached.

    ``rate`` is the nonnegative number of times the document is to be seen, at most ``most``; expected tokens of each domain (rate
    times words times posterior, summed) match the target weights times ``budget`` words, by default the words there are; with
    ``thin`` it is set so that the first domain keeps just its words and no domain gains any. Where rates within the bounds cannot
    meet the targets they are the nearest that can: ``reached`` is false, and ``residual`` the share of the target words that is
    left off, the same in all rows. ``copies`` is the rate rounded up or down by a hash of
    doc_id. Null and empty texts have no words and the posteriors of a text without known terms. Posteriors are written once.
    """
    spark = docs.sparkSession
    names = list(targets)
    model = trained(docs, label_domains(labels), len(names))
    path = scratch_path(spark, "mixing")
    with_posteriors(docs, model).write.parquet(path)
    known = spark.read.parquet(path)
    present = known.select("n_words", F.posexplode("p").alias("c", "x")).groupBy("c").agg(F.sum(F.col("x") * F.col("n_words")).alias("t")).collect()
    held = np.zeros(len(names))
    for r in present:
        held[r["c"]] = r["t"]
    weights = np.array([targets[d] for d in names]) / sum(targets.values())
    words = held[0] / weights[0] if thin else held.sum() if budget is None else budget
    goal = weights * words
    if thin:
        goal = np.minimum(goal, held)  # rates of at most 1 can only thin
    fit = fitted(known, goal, most)
    steps = fit.steps

    def run(batches):
        for batch in batches:
            p = _matrix(batch.column("p"), len(names))
            columns = [batch.column("doc_id"), batch.column("n_words"), *[pa.array(p[:, c]) for c in range(len(names))], pa.array(_rates(p, steps, most))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", *[f"p_{d}" for d in names], "rate"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = known.mapInArrow(run, f"doc_id {kind}, n_words long, {', '.join(f'p_{d} double' for d in names)}, rate double")
    return out.withColumn("copies", F.floor(F.col("rate") + F.lit(1.0) - F.greatest(_uniform(F.col("doc_id")), F.lit(1e-9))).cast("int")).withColumns({"residual": F.lit(fit.residual), "reached": F.lit(fit.reached)})


def thinned(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``docs`` thinned towards the target weights: rates of at most 1, the first domain keeps its words; columns as they are."""
    rates = mixed(docs, labels, targets, most=1.0, thin=True)
    gone = rates.where("copies = 0 and n_words > 0").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # so no name can clash
    rows = rows.join(gone, F.col("row.doc_id") == F.col("gone"), "left_anti")
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
