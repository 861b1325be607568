"""Record-level expressions: labels, mapping, time, fingerprints, validation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilframe import params


def bound(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def item(fields: Column, key: str) -> Column:
    """Map value or null, also when the key is missing."""
    return F.try_element_at(fields, F.lit(key))


def first_filled(columns: Iterable[Column], default: str | None = None) -> Column:
    """First value with a non-blank text, trimmed."""
    filled = [F.when(F.trim(c) != "", F.trim(c)) for c in columns]
    if default is not None:
        filled.append(F.lit(default))
    return F.coalesce(*filled)


def source_label(fields: Column) -> Column:
    return first_filled([item(fields, k) for k in params.SOURCE_KEYS], "unknown")


def normalized_label(label: Column) -> Column:
    return F.lower(F.regexp_replace(label, r"(?U)[\s\-_]", ""))


def guess_asset(fields: Column) -> Column:
    filled = [F.when(item(fields, k) != "", item(fields, k)) for k in params.ASSET_KEYS]
    return F.coalesce(*filled, F.lit(""))


def clipped_trust(score: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)


def source_type(fields: Column) -> Column:
    """Source type from the key names, in detection order."""
    expr = None
    for mode, keys, name in params.SOURCE_TYPE_KEYS:
        tests = [F.map_contains_key(fields, k) for k in keys]
        hit = tests[0]
        for t in tests[1:]:
            hit = (hit | t) if mode == "any" else (hit & t)
        expr = F.when(hit, name) if expr is None else expr.when(hit, name)
    return expr.otherwise("generic")


def canonical_fields(fields: Column, kind: Column) -> Column:
    """MAP of canonical names: mapped fields, then same-named ones, nulls dropped.

    The mapping tables are one constant map, so a record costs one lookup per
    field it has.
    """
    tables = F.create_map(
        *[
            x
            for name, mapping in params.FIELD_MAPS.items()
            for x in (F.lit(name), F.create_map(*[F.lit(y) for kv in mapping.items() for y in kv]))
        ]
    )
    canonical = F.array(*[F.lit(c) for c in params.CANONICAL_FIELDS])
    present = F.filter(F.map_entries(fields), lambda e: e["value"].isNotNull())

    def merged(entries: Column) -> Column:
        names = F.try_element_at(tables, kind)
        mapped = F.filter(
            F.transform(entries, lambda e: F.struct(F.try_element_at(names, e["key"]).alias("key"), e["value"].alias("value"))),
            lambda e: e["key"].isNotNull(),
        )

        def with_direct(done: Column) -> Column:
            taken = F.transform(done, lambda e: e["key"])
            direct = F.filter(entries, lambda e: F.array_contains(canonical, e["key"]) & ~F.array_contains(taken, e["key"]))
            return F.concat(done, direct)

        return bound(mapped, with_direct)

    return F.map_from_entries(bound(present, merged))


def time_text(fields: Column) -> Column:
    """Text of the event time, from the candidate keys."""
    return first_filled([item(fields, k) for k in params.TIME_KEYS])


def read_time(raw: Column, as_of: Column) -> Column:
    """Time of a text, ``as_of`` where it can't be read. The text is named many times: as a column it is computed once."""
    epoch = F.when(raw.rlike(r"^-?\d+(\.\d+)?$"), F.timestamp_seconds(raw.try_cast("double")))
    # the shape tests spare failed parses, which cost an exception each
    read = lambda shape, fmt: F.when(raw.rlike(shape), F.try_to_timestamp(raw, F.lit(fmt)))
    return F.coalesce(
        read(r"^\d{4}-\d\d-\d\dT[\d:]{8}Z$", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        read(r"^\d{4}-\d\d-\d\d [\d:]{8}$", "yyyy-MM-dd HH:mm:ss"),
        read(r"^\d\d/\w{3}/\d{4}:[\d:]{8} ", "dd/MMM/yyyy:HH:mm:ss Z"),
        epoch,
        as_of,
    )


def event_time(fields: Column, as_of: Column) -> Column:
    """Event time from the candidate keys; ``as_of`` where none can be read."""
    return read_time(time_text(fields), as_of)


def audit_time(text: Column) -> Column:
    """Stored time text; a doubled offset ``+00:00Z`` is repaired."""
    return F.regexp_replace(F.regexp_replace(text, r"\+00:00Z$", "+00:00"), "Z$", "").try_cast("timestamp")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; accepts TIMESTAMP and TIMESTAMP_NTZ."""
    return F.unix_micros(ts.cast("timestamp"))


def time_of_day(ts: Column) -> Column:
    hour = F.hour(ts)
    return (
        F.when((hour >= 9) & (hour < 18), "business_hours")
        .when((hour >= 18) & (hour < 23), "off_hours")
        .otherwise("night")
    )


def calendar_flags(ts: Column) -> Column:
    month, day = F.month(ts), F.dayofmonth(ts)
    holiday = F.lit(False)
    for m, d in params.HOLIDAYS:
        holiday = holiday | ((month == m) & (day == d))
    election = F.lit(False)
    for start, end in params.ELECTION_WINDOWS:
        election = election | ts.cast("timestamp").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return F.struct(
        month.between(1, 5).alias("exam_season"),
        ((month == 3) & (day >= 22)).alias("govt_year_end"),
        election.alias("election_period"),
        holiday.alias("holiday_period"),
    )


def control_context(raw_text: Column, asset: Column) -> Column:
    """Control-system context with the defaults of an unknown asset."""
    from vigilframe.functions.text import first_signature

    unknown = params.UNKNOWN_ASSET
    return F.struct(
        first_signature(raw_text, params.OT_SIGNATURES_V2).alias("protocol"),
        asset["type"].alias("device_type"),
        F.coalesce(asset["safety_critical"], F.lit(False)).alias("safety_critical"),
        F.coalesce(asset["can_interrupt"], F.lit(True)).alias("can_interrupt"),
        F.coalesce(asset["can_reboot"], F.lit(True)).alias("can_reboot"),
        F.coalesce(asset["impact_if_compromised"], F.lit(unknown["impact_if_compromised"])).alias(
            "impact_if_compromised"
        ),
    )


def _json_string(text: Column) -> Column:
    """A JSON string literal; only texts that need escapes go through the encoder."""
    encoded = F.to_json(F.array(text))
    plain = ~text.rlike(r'["\\\x00-\x1F]')
    return F.when(plain, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(F.substring(encoded, F.lit(2), F.length(encoded) - 2))


def _ascii_escaped(doc: Column) -> Column:
    """Non-ASCII characters as lower-case escapes, as Python's json module writes them."""

    def escape(c: Column) -> Column:
        code = F.ascii(c)
        low = F.lower(F.lpad(F.hex(code), 4, "0"))
        lead = F.lower(F.hex(F.floor((code - 65536) / 1024).cast("bigint") + 55296))
        trail = F.lower(F.hex((code - 65536) % 1024 + 56320))
        u = F.lit("\\u")
        return F.when(code < 128, c).when(code < 65536, F.concat(u, low)).otherwise(F.concat(u, lead, u, trail))

    spelled = lambda d: F.array_join(F.transform(F.split(d, ""), escape), "")
    return bound(doc, lambda d: F.when(d.rlike(r"[^\x00-\x7F]"), spelled(d)).otherwise(d))


def canonical_json(fields: Column, numeric: Iterable[str] = ()) -> Column:
    """Sorted-key JSON text with ``", "`` and ``": "`` separators.

    ``numeric`` names the keys whose values are written without quotes.
    """
    numeric = list(numeric)

    def pair(e: Column) -> Column:
        value = _json_string(e["value"])
        if numeric:
            value = F.when(e["key"].isin(numeric), e["value"]).otherwise(value)
        return F.concat(_json_string(e["key"]), F.lit(": "), value)

    pairs = F.transform(F.array_sort(F.map_entries(fields)), pair)
    return _ascii_escaped(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")))


def content_fingerprint(fields: Column, numeric: Iterable[str] = ()) -> Column:
    return F.sha2(canonical_json(fields, numeric), 256)


def cache_key(kind: Column, value: Column) -> Column:
    return F.substring(F.sha2(F.concat(kind, F.lit("::"), value), 256), 1, 32)


def is_hex_digest(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def is_unit(value: Column) -> Column:
    return F.coalesce(value.between(0.0, 1.0), F.lit(False))


def expand_embedding(vector: Column, dim: int) -> Column:
    """A one-element zero vector stands for ``dim`` zeros."""
    zero = (F.size(vector) == 1) & (F.element_at(vector, 1) == 0)
    return F.when(zero, F.array_repeat(F.lit(0.0).cast("float"), dim)).otherwise(vector)


def appended(ids: Column, new: Column) -> Column:
    """The list with the id added when it is not there yet."""
    return F.array_union(F.coalesce(ids, F.array().cast("array<string>")), F.array(new))


def technique_category(chain: Column) -> Column:
    """Incident category, the first rule that matches."""
    expr = F.when(chain.isNull() | (F.size(chain) == 0), "Unknown")
    for techniques, category in params.TECHNIQUE_CATEGORIES:
        expr = expr.when(F.arrays_overlap(chain, F.array(*[F.lit(t) for t in techniques])), category)
    return expr.otherwise("Other")


def blast_label(score: Column) -> Column:
    return F.when(score < 0.3, "LOW").when(score < 0.7, "MEDIUM").otherwise("HIGH")


def deadline_seconds(detected: Column, as_of: Column) -> Column:
    """Seconds left to report, between zero and the full window."""
    left = F.unix_seconds(detected.cast("timestamp")) + params.REPORT_DEADLINE_SECONDS - F.unix_seconds(
        as_of.cast("timestamp")
    )
    return F.greatest(F.lit(0), F.least(F.lit(params.REPORT_DEADLINE_SECONDS), left)).cast("bigint")


def mitre_id(references: Column) -> Column:
    """External id of the first reference of the technique catalogue."""
    own = F.filter(references, lambda r: r["source_name"] == "mitre-attack")
    return F.coalesce(F.try_element_at(own, F.lit(1))["external_id"], F.lit(""))


def elapsed_seconds(ts: Column, base: Column) -> Column:
    return F.greatest(F.lit(0.0), (micros(ts) - micros(base)) / F.lit(1e6))


def time_code(seconds: Column, dim: int = 16) -> Column:
    """Sinusoidal code: sine on even, cosine on odd positions."""
    import math

    parts = []
    for i in range(0, dim, 2):
        rate = math.exp(i * (-math.log(10000.0) / dim))
        parts += [F.sin(seconds * F.lit(rate)), F.cos(seconds * F.lit(rate))]
    return F.array(*parts)
