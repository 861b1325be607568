"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.words import SPACE_CHARS, bind, words

SYMBOLS = "#*$%&|<>"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his this are or from at which an have "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec "
    "el los que y en del las por con para una su al lo como más pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= metric <= high``; None is no bound."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


# metric: SQL over the counts of ``counts``. A ratio of nothing is null and fails no rule.
RULES = (
    Rule("word_length", "word_chars / n_words", 2, 25),
    Rule("symbols_per_word", "n_symbols / n_words", None, 0.1),
    Rule("stop_words", "n_stop_words / n_words", 0.01, None),
    Rule("dup_lines", "n_dup_lines / n_lines", None, 0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines / n_lines", None, 0.3),
    Rule("bullet_lines", "n_bullet_lines / n_lines", None, 0.9),
)
MIN_WORDS, MOST_REPEATED = 50, 50


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeated_words(w: Column) -> Column:
    """Words covered by the three-word windows that occur at least twice: sort the windows, keep neighbours that are equal."""
    n = F.size(w)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(v: Column) -> Column:
        ordered = F.array_sort(F.transform(v, lambda s, i: F.struct(s.alias("s"), i.alias("i"))))

        def starts(o: Column) -> Column:
            twice = F.filter(o, lambda e, k: (F.get(o, k - 1)["s"].eqNullSafe(e["s"])) | (F.get(o, k + 1)["s"].eqNullSafe(e["s"])))
            return F.array_sort(F.transform(twice, lambda e: e["i"]))

        reach = bind(bind(ordered, starts), lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))
        return F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0)).otherwise(reach)

    return F.when(n < 4, F.lit(0)).otherwise(bind(windows, covered)).cast("long")


def counts(text: Column) -> Column:
    """All counts of a text as a struct; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
            _repeated_words(w).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: F.endswith(x, F.lit("...")) | F.endswith(x, F.lit("…")))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.filter(lines, lambda x: F.left(x, F.lit(1)).isin("-", "*", "•"))).cast("long").alias("n_bullet_lines"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: _without(x, SPACE_CHARS) != "")
    return F.struct(
        bind(words(text), of_words).alias("w"),
        bind(lines, of_lines).alias("l"),
        F.length(_without(text, SPACE_CHARS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
    )


def verdict(rules: tuple[Rule, ...]) -> str:
    """The table as one SQL condition over the counts."""
    parts = []
    for r in rules:
        metric = r.metric.replace("/ n_words", "/ nullif(n_words, 0)").replace("/ n_lines", "/ nullif(n_lines, 0)")
        parts += [f"coalesce({metric} >= {r.low}, true)"] * (r.low is not None) + [f"coalesce({metric} <= {r.high}, true)"] * (r.high is not None)
    return " AND ".join(parts) or "true"


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = MIN_WORDS, most_repeated: int = MOST_REPEATED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, base_failed, kept and the names of the failed rules.

    A text fails the base under ``min_words`` words, or if more than ``most_repeated`` % of its words lie in repeated three-word
    windows. Null and empty texts have no words and fail. Further columns are ignored; repeated rows get a row each. A map over
    the rows without shuffle, whatever the keys.
    """
    base = docs.select("doc_id", counts(F.col("text")).alias("_c"))
    flat = base.select(
        "doc_id", "_c.w.n_words", "_c.word_chars", "_c.n_symbols", "_c.l.n_dup_lines", "_c.w.n_repeat_words", "_c.w.n_stop_words", "_c.l.n_lines",
        "_c.l.n_ellipsis_lines", "_c.l.n_bullet_lines")
    failed = F.expr(f"n_words < {min_words} OR 100 * n_repeat_words > {most_repeated} * n_words")
    names = F.array_compact(F.array(*[F.when(~F.expr(verdict((r,))), F.lit(r.name)) for r in rules]))
    return flat.select("*", failed.alias("base_failed"), (~failed & F.expr(verdict(rules))).alias("kept"), names.alias("failed_rules"))
