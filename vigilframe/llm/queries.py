"""Queries of the training-data operators, applied with production parameters to whole tables, and their SQL twins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from vigilframe.llm.chats import formatted, read_back
from vigilframe.llm.codes import vector_codes
from vigilframe.llm.jaccard import jaccard_components
from vigilframe.llm.language import languages
from vigilframe.llm.licenses import KNOWN_LICENSES, canonical_sql, license_scan
from vigilframe.llm.lines import RUN_WORDS, UNIT_ENDS, without_repeats
from vigilframe.llm.mixing import mixed
from vigilframe.llm.neighbours import nearest
from vigilframe.llm.packing import packed
from vigilframe.llm.quality import RULES, STOP_WORDS, quality_rules, verdict
from vigilframe.llm.runs import longest_by_exponent, periodic_runs, with_periodic_tails
from vigilframe.llm.toxicity import held_out, toxicity_scores, trained, training_labels
from vigilframe.llm.warc import archived
from vigilframe.session import configure, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(configure(spark), str(sf_dir).rstrip("/"))
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, links from 90 %."""
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules"
    ).withColumn("failed_rules", F.array_join("failed_rules", ","))


_SPACE_CLASS = r"[\x20\x09-\x0D]"
_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
_FAILED = ", ".join(f"CASE WHEN NOT ({verdict((r,))}) THEN '{r.name}' END" for r in RULES)

ORACLE_SQL["op2_quality_rules"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)),
wc AS (SELECT rid, count(*) AS n_words, count(*) FILTER (lower(word) IN ({_STOPS})) AS n_stop_words FROM w GROUP BY rid),
t AS (SELECT rid, i, word || ' ' || lead(word) OVER p || ' ' || lead(word, 2) OVER p AS g FROM w WINDOW p AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM t WHERE g IS NOT NULL) WHERE n > 1),
rw AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
l AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lc AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (ends_with(line, '...') OR ends_with(line, '…')) AS n_ellipsis_lines, count(*) FILTER (left(line, 1) IN ('-', '*', '•')) AS n_bullet_lines
    FROM l GROUP BY rid),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, length(regexp_replace(text, '{_SPACE_CLASS}', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines, coalesce(n_bullet_lines, 0) AS n_bullet_lines
    FROM d LEFT JOIN wc USING (rid) LEFT JOIN rw USING (rid) LEFT JOIN lc USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {verdict(RULES)} AS kept,
    concat_ws(',', {_FAILED}) AS failed_rules FROM b
"""


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of adjacent lines, sentences and clauses of 40 words or more, normalised; what is cut is given as spans of the original text."""
    out = without_repeats(table(spark, sf_dir, "documents"), "run", RUN_WORDS)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["begin"], s["end"])), ",")
    return out.select("doc_id", F.size("spans").cast("long").alias("n_removed"), spans.alias("removed"), "text")


# Words and the blanks between them as pieces; runs of whole units by an ordered join of unit begins with unit ends.
ORACLE_SQL["op8_line_dedup"] = f"""
WITH p AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ps FROM documents)),
q AS (SELECT *, regexp_matches(piece, '[^\x20\x09-\x0D]') AS word, sum(length(piece)) OVER o - length(piece) AS b, lead(piece) OVER o AS after FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
w AS MATERIALIZED (SELECT doc_id, i, b, piece, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k,
    coalesce(contains(after, chr(10)), true) OR right(piece, 1) IN ({", ".join(f"'{c}'" for c in UNIT_ENDS)}) OR row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1 AS ends FROM q WHERE word),
a AS MATERIALIZED (SELECT doc_id, list(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ORDER BY k) AS ws FROM w GROUP BY doc_id),
s AS (SELECT doc_id, k, k + {RUN_WORDS - 1} AS far FROM (SELECT *, lag(ends, 1, true) OVER (PARTITION BY doc_id ORDER BY k) AS begins FROM w) WHERE begins),
r AS (SELECT s.doc_id, s.k, e.k AS stop FROM s ASOF JOIN (SELECT doc_id, k FROM w WHERE ends) e ON s.doc_id = e.doc_id AND s.far <= e.k),
f AS (SELECT doc_id, k, stop, row_number() OVER (PARTITION BY array_to_string(list_slice(ws, k, stop), ' ') ORDER BY doc_id, k) > 1 AS again FROM r JOIN a USING (doc_id)),
g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(k, stop + 1)) AS k FROM f WHERE again),
m AS (SELECT w.doc_id, w.i, w.b, w.piece, g.k AS gone FROM w LEFT JOIN g USING (doc_id, k)),
n AS MATERIALIZED (SELECT q.doc_id, q.i, q.b, q.piece, coalesce(CASE WHEN q.word THEN m.gone IS NOT NULL
    ELSE lag(m.gone) OVER o IS NOT NULL AND lead(m.gone) OVER o IS NOT NULL END, false) AS gone FROM q LEFT JOIN m USING (doc_id, i) WINDOW o AS (PARTITION BY q.doc_id ORDER BY q.i)),
h AS (SELECT *, sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM n),
x AS (SELECT doc_id, CAST(min(b) AS BIGINT) AS b, CAST(max(b + length(piece)) AS BIGINT) AS e FROM h WHERE gone GROUP BY doc_id, island),
y AS (SELECT doc_id, count(*) AS n, string_agg(b || '-' || e, ',' ORDER BY b) AS removed FROM x GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(piece, '' ORDER BY i) AS kept FROM n WHERE NOT gone GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_removed, coalesce(removed, '') AS removed, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text
FROM documents LEFT JOIN y USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query
def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_REPLACE = "regexp_replace({}, '{}', '{}', 'g')"
_KNOWN = ", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in KNOWN_LICENSES)

ORACLE_SQL["op10_license_digests"] = f"""
WITH known AS (SELECT {canonical_sql("body", _REPLACE)} AS form, min(license_id) AS license_id FROM (VALUES {_KNOWN}) AS v(license_id, body) GROUP BY 1),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, 'text' AS kind, 0 AS place, text AS unit FROM d
    UNION ALL SELECT doc_id, 'paragraph', i - 1, x FROM (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM
        (SELECT doc_id, regexp_split_to_array(text, '\n[ \t\r]*\n') AS a FROM d) WHERE len(a) > 1)
    UNION ALL SELECT doc_id, 'line', i - 1, x FROM (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM
        (SELECT doc_id, string_split(text, chr(10)) AS a FROM d) WHERE len(a) > 1)),
f AS (SELECT doc_id, kind, place, {canonical_sql("unit", _REPLACE)} AS form FROM p)
SELECT doc_id, license_id, bool_or(kind = 'text') AS whole_text, count(*) AS n_units, CAST(min(CASE WHEN kind = 'line' THEN place END) AS BIGINT) AS first_line
FROM f JOIN known USING (form) WHERE form <> '' GROUP BY doc_id, license_id
"""


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from labels outside the held-out fold, scored over every text."""
    docs = table(spark, sf_dir, "documents")
    model = trained(docs, training_labels(table(spark, sf_dir, "labels")))
    out = toxicity_scores(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of the label table, posteriors of every text, rates that match the target weights at the words there are."""
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


@query
def op1_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.where(F.col("vec_id") % 20 == 0), vectors, 20)


@query
def op4_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back; equal payloads are revisits whatever their length."""
    out = archived(spark, table(spark, sf_dir, "pages"), least_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


ORACLE_SQL["op4_warc_archives"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
s AS (SELECT page_id, html, first, sha1(html) AS hex FROM p JOIN f USING (html)),
g AS (SELECT page_id, generate_series AS k,
    CAST(('0x' || substr(hex, CAST(5 * generate_series + 1 AS INTEGER), 5)) AS INTEGER) AS v FROM s, generate_series(0, 7)),
b AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 10) % 32 + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1), '' ORDER BY k) AS payload_digest
    FROM g GROUP BY page_id)
SELECT page_id, strlen(html) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS problem FROM s JOIN b USING (page_id)
"""


@query
def op6_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, with a text model of the languages that documents name."""
    return languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with periodic tails by the checksum of their id; runs of four periods and six words or more."""
    out = periodic_runs(with_periodic_tails(table(spark, sf_dir, "documents")), exponent=4, least=6)
    out = out.withColumn("best", longest_by_exponent(F.col("runs")))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four parts, 256 entries each, four rounds."""
    rows, books = vector_codes(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Each round as a pair of common table expressions over (part, vector) and (part, entry)."""
    nearest = """SELECT v.part, v.vec_id, min({{'d': list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.entry}}) AS best
        FROM v JOIN {book} b ON v.part = b.part GROUP BY v.part, v.vec_id"""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"n{k} AS MATERIALIZED ({nearest.format(book=f'b{k}')})")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT part, best.e AS entry, place, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM (SELECT n.part, n.best, unnest(v.x) AS c, generate_subscripts(v.x, 1) AS place
                FROM n{k} n JOIN v USING (part, vec_id)) GROUP BY 1, 2, 3),
            b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN
                (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY place) AS x FROM m{k} GROUP BY 1, 2) m USING (part, entry))""")
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, part, x[(part * len(x)) // {parts} + 1 : ((part + 1) * len(x)) // {parts}] AS x FROM k, (SELECT unnest(range({parts})) AS part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM v WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries})),
{", ".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
c AS (SELECT vec_id, string_agg(lower(printf('%02x', best.e)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM n{rounds} GROUP BY 1),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM c JOIN k USING (vec_id) GROUP BY 1)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM c JOIN k USING (vec_id) JOIN l ON k.label IS NOT DISTINCT FROM l.label, h
"""


ORACLE_SQL["op12_vector_codes"] = _codes_sql()


@query
def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted, written, and read back from the tokens."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = scratch_path(spark, "chats")
    formatted(turns).write.parquet(path)
    return read_back(spark.read.parquet(path)).drop("n_tokens")


# Control strings become two characters each, so the formatted length follows from the texts.
_ESCAPED_TEXT = r"replace(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t'), '</role>', '\r')"

ORACLE_SQL["op13_chat_formatting"] = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
f AS (SELECT *, length(CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' WHEN 'assistant' THEN '### Assistant: '
    ELSE '### Other: ' || role || '</role>' END) + length({_ESCAPED_TEXT}) + length('</turn>') + 1 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id
"""


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
