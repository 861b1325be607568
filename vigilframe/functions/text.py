"""Text rules as column expressions: sanitising, screening, entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe import params
from vigilframe.functions.records import bound


def _literal_replacement(text: str) -> Column:
    return F.lit(text.replace("\\", "\\\\").replace("$", "\\$"))


def sanitize(text: Column, rules=params.SANITIZE_RULES) -> Column:
    """Apply the ordered rules; every rule sees the previous rule's output."""
    for _, pattern, replacement in rules:
        text = F.regexp_replace(text, F.lit(pattern), _literal_replacement(replacement))
    return text


def sanitize_with_counts(text: Column, rules=params.SANITIZE_RULES) -> Column:
    """STRUCT<text, events ARRAY<STRUCT<rule, occurrences>>> in rule order."""
    counts, current = [], text
    for name, pattern, replacement in rules:
        counts.append(
            F.struct(
                F.lit(name).alias("rule"),
                F.coalesce(F.regexp_count(current, F.lit(pattern)), F.lit(0)).cast("bigint").alias("occurrences"),
            )
        )
        current = F.regexp_replace(current, F.lit(pattern), _literal_replacement(replacement))
    events = F.filter(F.array(*counts), lambda e: e["occurrences"] > 0)
    return F.struct(current.alias("text"), events.alias("events"))


def with_sanitized(df: DataFrame, column: str, out: str = "clean", events: str = "events", rules=params.SANITIZE_RULES) -> DataFrame:
    """Add the cleaned text and ARRAY<STRUCT<rule, occurrences>>, rule by rule.

    Each rule is its own projection, so a text is rewritten once per rule, and
    matches are only counted where the rule changed something.
    """
    staged, steps = df.withColumn("_t0", F.col(column)), []
    for i, (_, pattern, replacement) in enumerate(rules):
        staged = staged.withColumn(f"_t{i + 1}", F.regexp_replace(F.col(f"_t{i}"), F.lit(pattern), _literal_replacement(replacement)))
    for i, (name, pattern, _) in enumerate(rules):
        changed = ~F.col(f"_t{i}").eqNullSafe(F.col(f"_t{i + 1}"))
        steps.append(
            F.when(
                changed,
                F.struct(F.lit(name).alias("rule"), F.regexp_count(F.col(f"_t{i}"), F.lit(pattern)).cast("bigint").alias("occurrences")),
            )
        )
    found = F.filter(F.array(*steps), lambda e: e.isNotNull())
    return staged.withColumn(events, found).withColumn(out, F.col(f"_t{len(rules)}")).drop(*[f"_t{i}" for i in range(len(rules) + 1)])


# A string of a JSON text, with the colon that makes it a key, or what stands between strings. All steps are possessive, so
# that a long string needs no stack.
JSON_PIECE = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?+|[^"]++'


def sanitize_json(doc: Column, rules=params.SANITIZE_RULES) -> Column:
    """A JSON text whose string values, at any depth, went through the rules one by one; keys, numbers and structure stay as they are.

    A value is read (so that escapes hide nothing), cleaned, and written back only if that changed it. One expression, linear in
    the text and without a shuffle. A text that is no JSON is cleaned as a whole, and so are documents with a key twice; null stays null.
    """

    def cleaned(piece: Column) -> Column:
        plain = F.substring(piece, F.lit(2), F.length(piece) - 2)
        value = F.when(F.contains(piece, F.lit("\\")), F.get(F.from_json(F.concat(F.lit("["), piece, F.lit("]")), "array<string>"), 0)).otherwise(plain)

        def written(pair: Column) -> Column:
            listed = F.to_json(F.array(pair["after"]))
            return F.when(pair["after"].eqNullSafe(pair["before"]), piece).otherwise(F.substring(listed, F.lit(2), F.length(listed) - 2))

        both = bound(value, lambda v: F.struct(v.alias("before"), sanitize(v, rules).alias("after")))
        return F.when(piece.startswith('"') & piece.endswith('"'), bound(both, written)).otherwise(piece)

    pieces = F.regexp_extract_all(doc, F.lit(JSON_PIECE), F.lit(0))
    return F.when(F.try_parse_json(doc).isNotNull(), F.array_join(F.transform(pieces, cleaned), "")).otherwise(sanitize(doc, rules))


def sanitize_map(fields: Column) -> Column:
    """Sanitise every value of a MAP<STRING,STRING>; values that are JSON objects or arrays keep their structure."""
    return F.transform_values(fields, lambda _, v: F.when(v.rlike(r"^\s*[\[{]"), sanitize_json(v)).otherwise(sanitize(v)))


def first_signature(text: Column, signatures) -> Column:
    """Name of the first signature list with a member inside the lower-cased text."""

    def pick(low: Column) -> Column:
        expr = None
        for name, words in signatures:
            hit = F.lit(False)
            for word in words:
                hit = hit | low.contains(word)
            expr = F.when(hit, name) if expr is None else expr.when(hit, name)
        return expr

    return bound(F.lower(text), pick)


def keys_and_values(fields: Column) -> Column:
    """All keys and values of a map as one text."""
    return F.array_join(
        F.transform(F.map_entries(fields), lambda e: F.concat_ws(" ", e["key"], F.coalesce(e["value"], F.lit("None")))),
        " ",
    )


def values_text(fields: Column) -> Column:
    return F.array_join(F.transform(F.map_values(fields), lambda v: F.coalesce(v, F.lit("None"))), " ")


def flatten_json_values(doc: Column) -> Column:
    """All scalar values of a JSON text, at any depth and in order, joined by blanks; nulls are left out.

    Keys are dropped, texts decoded by the JSON reader, and booleans spelled True and False. The scan is one expression
    whatever the schema is.
    """
    token = r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+")(\s*:)?|(-?\d[\d.eE+-]*|true|false)'
    found = F.regexp_extract_all(doc, F.lit(token), F.lit(0))
    scalars = F.filter(found, lambda t: ~t.rlike(r'^"(?s).*:\s*$') | t.rlike(r'"$'))

    def value(t: Column) -> Column:
        read = F.get(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), 0)
        return F.when(t.startswith('"'), read).when(t.isin("true", "false"), F.initcap(t)).otherwise(t)

    return F.array_join(F.transform(scalars, value), " ")


def first_group(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def named_entities(text: Column) -> Column:
    """STRUCT of the first ip, user, process, domain and hash in the text."""
    return F.struct(*[first_group(text, pattern).alias(name) for name, pattern in params.NER_PATTERNS])


def screen_output(text: Column, chars: int | None = None) -> Column:
    """ARRAY<STRUCT<pattern_name, match>> of secrets and personal data found; ``chars`` cuts what is shown of a match."""
    hits = [
        F.struct(
            F.lit(name).alias("pattern_name"),
            _shown(F.regexp_extract(text, pattern, 0), chars).alias("match"),
        )
        for name, pattern in params.OUTPUT_PATTERNS
    ]
    return F.filter(F.array(*hits), lambda h: h["match"] != "")


def injection_flags(text: Column) -> Column:
    """ARRAY<STRING> of the prompt-injection patterns that fire."""
    flags = [F.when(text.rlike("(?iU)" + p), F.lit(p)) for p in params.INJECTION_PATTERNS]
    return F.filter(F.array(*flags), lambda f: f.isNotNull())


def _shown(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def injection_screen(text: Column, chars: int | None = None) -> Column:
    """Flags, verdict and the text that was screened, cut to ``chars`` if given."""
    flags = injection_flags(text)
    detected = F.size(flags) > 0
    return F.struct(
        detected.alias("injection_detected"),
        _shown(text, chars).alias("excerpt"),
        F.when(detected, "INJECTION_SUSPECTED").otherwise("CLEAN").alias("verdict"),
        flags.alias("flags"),
    )


def key_values(line: Column) -> Column:
    """MAP of the k=v pairs of a line, or null when there are fewer than two.

    A repeated key keeps its last value.
    """
    pairs = F.regexp_extract_all(line, F.lit(r'(\w+)=("[^"]*"|\S+)'), F.lit(0))
    entries = F.transform(
        pairs,
        lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("key"),
            F.regexp_replace(p.substr(F.instr(p, "=") + 1, F.length(p)), r'^"|"$', "").alias("value"),
        ),
    )
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["key"] == e["key"]),
    )
    return F.when(F.size(pairs) >= 2, F.map_from_entries(last))


def iocs(text: Column) -> Column:
    """ARRAY<STRUCT<type, value, priority>> of huntable values.

    Private addresses and short domains are left out; a value found under two
    types keeps the better priority; sorted by priority, first seen first.
    """
    found = None
    for kind, pattern, priority in params.IOC_PATTERNS:
        values = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
        if kind == "ip":
            values = F.filter(values, lambda v: ~v.rlike(params.PRIVATE_IP_HUNT))
        if kind == "domain":
            values = F.filter(values, lambda v: F.length(v) >= 5)
        typed = F.transform(values, _tagged(kind, priority))
        found = typed if found is None else F.concat(found, typed)

    def first_of_value(all_: Column) -> Column:
        return F.filter(
            all_,
            lambda t, i: ~F.exists(F.slice(all_, 1, i), lambda e: e["value"] == t["value"]),
        )

    return bound(found, first_of_value)


def _tagged(kind: str, priority: int):
    return lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), F.lit(priority).alias("priority"))


def public_ips(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(params.IP_PATTERN), F.lit(1))
    return F.filter(found, lambda v: ~v.rlike(params.PRIVATE_IP_SHARE))


def file_hashes(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(params.HASH_PATTERN), F.lit(1)))


def public_domains(text: Column) -> Column:
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(params.DOMAIN_PATTERN), F.lit(1)))
    return F.filter(found, lambda v: (F.length(v) > 5) & ~v.rlike(params.IP_PATTERN))


def shareable_entities(text: Column) -> Column:
    return F.struct(
        public_ips(text).alias("ips"), file_hashes(text).alias("hashes"), public_domains(text).alias("domains")
    )


def stix_pattern(kind: Column, value: Column) -> Column:
    return (
        F.when(kind == "ip", F.format_string("[ipv4-addr:value = '%s']", value))
        .when(kind == "domain", F.format_string("[domain-name:value = '%s']", value))
        .when(kind == "hash_sha256", F.format_string("[file:hashes.'SHA-256' = '%s']", value))
        .when(kind == "hash_sha1", F.format_string("[file:hashes.'SHA-1' = '%s']", value))
        .when(kind == "hash_md5", F.format_string("[file:hashes.MD5 = '%s']", value))
        .when(kind == "url", F.format_string("[url:value = '%s']", value))
        .otherwise(F.format_string("[artifact:value = '%s']", value))
    )


def stix_pattern_value(pattern: Column) -> Column:
    return first_group(pattern, "= '([^']+)'")


def hash_kind(value: Column) -> Column:
    """Indicator type by digest length, SHA-1 kept apart from MD5."""
    size = F.length(value)
    return F.when(size == 64, "hash_sha256").when(size == 40, "hash_sha1").otherwise("hash_md5")
