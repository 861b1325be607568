"""Nested payloads: a walk over JSON documents level by level, and what the sanitiser finds at which path."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe import params
from vigilframe.functions import text
from vigilframe.session import cut_lineage


def leaves(df: DataFrame, key: str, doc: str) -> DataFrame:
    """(key, path, value, is_text) of every scalar of the JSON documents in ``doc``, at any depth.

    Paths are written ``$.outer.inner[0]``; a key with other than word characters is ``["quoted"]``. Each level is one explode of the containers of the level
    before; the walk ends when no container is left. Null and malformed documents have no leaves, empty containers neither; a JSON null
    is a leaf without a value. Repeated keys of ``df`` keep their rows apart only by path.
    """
    level = df.select(F.col(key).alias("_key"), F.lit("$").alias("path"), F.try_parse_json(F.col(doc)).alias("v")).where("v is not null")
    found = []
    while True:
        level = cut_lineage(level.withColumn("kind", F.schema_of_variant("v")))
        nested = level.where(F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY"))
        scalar = level.where(~(F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")))
        value = F.try_variant_get("v", "$", "string")
        found.append(scalar.select("_key", "path", value.alias("value"), (F.col("kind") == "STRING").alias("is_text")))
        if nested.isEmpty():
            break
        parts = nested.select("_key", "path", "v").lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()))
        name = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(
            F.col("key").rlike(r"^\w+$"), F.concat(F.lit("."), F.col("key"))
        ).otherwise(F.to_json(F.array("key")))
        level = parts.select("_key", F.concat("path", name).alias("path"), F.col("value").alias("v"))
    return functools.reduce(DataFrame.unionByName, found).withColumnRenamed("_key", key)


def sanitizer_findings(df: DataFrame, key: str, doc: str) -> DataFrame:
    """(key, path, rule, occurrences) of everything the rules strip from the string values of the documents.

    All documents are walked: a walk costs less than cleaning a document to see whether it has to be walked. The rules only see
    values that can match one of them.
    """
    values = leaves(df, key, doc).where(F.col("is_text") & F.col("value").rlike(params.SANITIZE_NEEDS))
    cleaned = text.with_sanitized(values, "value")
    # a plain explode puts a filter on its array below, which would run every rule again for each rule after it
    events = cleaned.select(key, "path", F.explode_outer("events").alias("_event")).where("_event is not null")
    return events.select(key, "path", "_event.rule", "_event.occurrences")
