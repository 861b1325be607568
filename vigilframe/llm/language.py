"""Language by Bayesian evidence fusion: text likelihood, declared markup language, address suffix and smoothed host priors."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.llm.words import lowered, text_chunks
from vigilframe.session import scratch_path

BITS = 16
# Bound of the labelled texts per language that the text model is fitted on.
SAMPLE_PER_LANGUAGE = 400
# Trigrams that a text counts for at most, as neighbouring trigrams are not independent; smoothing of counts.
EVIDENCE, SMOOTHING = 60.0, 0.5
# Pages that the next level up counts for in a host's prior.
HOST_WEIGHT = 5.0

_TAGS = re.compile(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>")


def visible(html: str | None) -> str:
    """Text without comments, scripts, styles and tags."""
    return _TAGS.sub(" ", html) if html else ""


def _trigrams(column: pa.Array):
    """(number of texts, text number, hashed byte trigram) pairs; white space counts as one blank character of its own."""
    for _, data, offsets in text_chunks(column):
        body = lowered(data[offsets[0] : offsets[-1]]).astype(np.uint32)
        body[(body >= 9) & (body <= 13)] = 32
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        if len(body) < 3:
            yield len(offsets) - 1, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        gram = body[:-2] << 16 | body[1:-1] << 8 | body[2:]
        same = (text[:-2] == text[2:]) & ~((body[:-2] == 32) & (body[1:-1] == 32))
        yield len(offsets) - 1, text[:-2][same], ((gram[same] * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


def text_model(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages of ``docs`` (text, lang) and their log shares of trigrams, from a bounded sample of texts of each."""
    labelled = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("_h"))
    # Only hashes are ranked; a bound per language, of which the model holds one row each, then picks the texts in place.
    place = Window.partitionBy("lang").orderBy("_h")
    ranked = labelled.select("lang", "_h").distinct().withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= per_language)
    bounds = ranked.groupBy("lang").agg(F.max("_h").alias("most")).collect()
    picked = functools.reduce(lambda a, r: a | ((F.col("lang") == r["lang"]) & (F.col("_h") <= r["most"])), bounds, F.lit(False))
    sample = labelled.where(picked).groupBy("lang", "_h").agg(F.min("text").alias("text")).select("lang", "text")
    sample = sample.repartition("lang")  # bounded, and one table of counts for each language goes to the driver

    def run(batches):
        for batch in batches:
            langs, at = np.array(batch.column("lang").to_pylist()), 0
            total = {lang: np.zeros(1 << BITS, np.int64) for lang in set(langs)}
            for n, text, gram in _trigrams(batch.column("text")):
                for lang in set(langs[at : at + n]):
                    own = (langs[at : at + n] == lang)[text]
                    total[lang] += np.bincount(gram[own], minlength=1 << BITS)
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["lang", "counts"])

    sums: dict[str, np.ndarray] = {}
    for r in sample.mapInArrow(run, "lang string, counts binary").collect():
        sums[r["lang"]] = sums.get(r["lang"], 0) + np.frombuffer(r["counts"], np.int64)
    names = sorted(sums)
    shares = np.array([sums[x] + SMOOTHING for x in names]) if names else np.zeros((0, 1 << BITS))
    return names, np.log(shares / shares.sum(axis=1, keepdims=True))


def declared_language(html: Column) -> Column:
    """Primary subtag of the lang attribute of the html element, '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8})", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _normal(values: list[Column]) -> list[Column]:
    total = sum(values[1:], values[0])
    return [v / total for v in values]


def languages(pages: DataFrame, docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, host_weight: float = HOST_WEIGHT) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, lang, probability, text_lang, declared, host.

    The text model is learned from ``docs`` (text, lang). A page's text gives a posterior of its own; sums of these over all pages,
    grouped by declared language, by address suffix, and by host, parent domain and suffix, give the likelihoods of declaration
    and suffix and the priors of hosts, each level smoothed towards the next, the last one being all pages. A page's own share is
    taken out of its host's prior. The sums are combined before each shuffle; hosts and declarations are joined back by key, where
    adaptive execution splits hot hosts.
    Null or empty pages are decided by the other evidence. ``lang`` is null only if ``docs`` names no language. Ties go to the
    language first in the alphabet. Repeated rows are counted and returned each; further columns are ignored.
    """
    spark = pages.sparkSession
    names, model = text_model(docs, per_language)
    base = pages.select("page_id", "url", "html")
    if not names:
        return base.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), declared_language(F.col("html")).alias("declared"), host(F.col("url")).alias("host"))
    width = len(names)

    def run(batches):
        for batch in batches:
            plain = pa.array([visible(x) for x in batch.column("html").to_pylist()], pa.string())
            parts = [np.zeros((0, width))]
            for n, text, gram in _trigrams(plain):
                held = np.bincount(text, minlength=n)
                z = np.stack([np.bincount(text, weights=model[c][gram], minlength=n) for c in range(width)], axis=1)
                z = z * np.minimum(1, EVIDENCE / np.maximum(held, 1))[:, None]
                e = np.exp(z - z.max(axis=1, keepdims=True))
                parts.append(e / e.sum(axis=1, keepdims=True))
            p = np.concatenate(parts)
            offsets = pa.array(np.arange(len(p) + 1) * width, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "declared")), pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))],
                ["page_id", "host", "declared", "p"])

    path = scratch_path(spark, "languages")
    kind = pages.schema["page_id"].dataType.simpleString()
    told = base.select("page_id", host(F.col("url")).alias("host"), declared_language(F.col("html")).alias("declared"), "html")
    told.mapInArrow(run, f"page_id {kind}, host string, declared string, p array<double>").write.parquet(path)
    # No text posterior is quite 0 or 1, so other evidence can overrule it.
    seen = spark.read.parquet(path).withColumn("p", F.transform("p", lambda x: x * (1 - 1e-6 * width) + 1e-6))
    columns = [F.col("p")[c].alias(f"p{c}") for c in range(width)]
    flat = seen.select("page_id", "host", "declared", *columns)
    sums = [F.sum(f"p{c}").alias(f"n{c}") for c in range(width)]

    hosts = flat.groupBy("host").agg(*sums)
    hosts = hosts.withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1)).withColumn("parent", F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1))
    total = hosts.agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in range(width)]).first()
    whole = np.array([total[f"n{c}"] or 0.0 for c in range(width)]) + SMOOTHING
    share = whole / whole.sum()

    def level(column: str, above: DataFrame | None, on: str | None) -> DataFrame:
        """Smoothed shares q0.. by ``column``; the level above it is joined by ``on``."""
        keys = [column] + ([on] if on else [])
        rows = hosts.groupBy(*keys).agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in range(width)])
        rows = rows if above is None else rows.join(above.select(F.col(on), *[F.col(f"q{c}").alias(f"u{c}") for c in range(width)]), on)
        up = [F.lit(float(share[c])) if above is None else F.col(f"u{c}") for c in range(width)]
        size = sum((F.col(f"n{c}") for c in range(1, width)), F.col("n0"))
        return rows.select(*keys, *[((F.col(f"n{c}") + host_weight * up[c]) / (size + host_weight)).alias(f"q{c}") for c in range(width)])

    suffixes = level("suffix", None, None)
    parents = level("parent", suffixes, "suffix")
    hosts = hosts.join(parents.select("parent", *[F.col(f"q{c}").alias(f"u{c}") for c in range(width)]), "parent")
    # The likelihood of a suffix in a language; its share of all pages is the same for all languages and falls out.
    hosts = hosts.join(suffixes.select("suffix", *[(F.col(f"q{c}") / float(share[c])).alias(f"s{c}") for c in range(width)]), "suffix")
    declared = flat.groupBy("declared").agg(*sums)
    held = sum((F.col(f"n{c}") for c in range(1, width)), F.col("n0"))
    declared = declared.select("declared", *[((F.col(f"n{c}") + host_weight * float(share[c])) / (held + host_weight) / float(share[c])).alias(f"d{c}") for c in range(width)])

    joined = flat.join(hosts, "host").join(declared, "declared")
    others = sum((F.col(f"n{c}") - F.col(f"p{c}") for c in range(1, width)), F.col("n0") - F.col("p0"))
    prior = [(F.greatest(F.col(f"n{c}") - F.col(f"p{c}"), F.lit(0.0)) + host_weight * F.col(f"u{c}")) / (others + host_weight) for c in range(width)]
    fused = _normal([F.col(f"p{c}") * prior[c] * F.col(f"d{c}") * F.col(f"s{c}") for c in range(width)])
    out = joined.select("page_id", "host", "declared", F.array(*[F.col(f"p{c}") for c in range(width)]).alias("p"), F.array(*fused).alias("f"))
    named = F.array(*[F.lit(x) for x in names])
    best = lambda a: F.get(named, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    return out.select("page_id", best(F.col("f")).alias("lang"), F.array_max("f").alias("probability"), best(F.col("p")).alias("text_lang"), "declared", "host")
