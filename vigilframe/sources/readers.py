"""Event readers. Each has a path form and a form on already loaded text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.functions import records, text

EVENT_MAP = "map<string,string>"


def json_fields(doc: Column) -> Column:
    """JSON object text -> MAP of field texts; malformed text keeps the text and an error mark.

    Nested values stay JSON text, nulls become empty.
    """
    parsed = F.from_json(doc, EVENT_MAP, {"mode": "PERMISSIVE"})
    ok = F.try_parse_json(doc).isNotNull()
    filled = F.transform_values(parsed, lambda _, v: F.coalesce(v, F.lit("")))
    bad = F.create_map(F.lit("message"), doc, F.lit("parse_error"), F.lit("invalid_json"))
    return F.when(ok & parsed.isNotNull(), filled).otherwise(bad)


def json_events(docs: DataFrame, column: str = "value") -> DataFrame:
    """Object or array-of-object texts -> one ``raw`` map per object."""
    doc = F.col(column)
    is_array = F.ltrim(doc).startswith("[") & F.try_parse_json(doc).isNotNull()
    items = F.when(is_array, F.from_json(doc, "array<string>")).otherwise(F.array(doc))
    # arrays of objects keep each object as its own JSON text
    objects = F.when(is_array, F.from_json(doc, "array<map<string,string>>"))
    plain = F.transform(items, lambda d: json_fields(d))
    filled = F.transform(objects, lambda m: F.transform_values(m, lambda _, v: F.coalesce(v, F.lit(""))))
    rows = F.filter(F.coalesce(filled, plain), lambda m: m.isNotNull())
    return docs.withColumn("raw", F.explode(rows))


def read_json_events(spark: SparkSession, path: str) -> DataFrame:
    """One file is one document (an object or an array)."""
    docs = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("source"))
    return wrapped(json_events(docs))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines files: splittable; malformed lines are kept and marked."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_name").alias("source"))
    return wrapped(lines.withColumn("raw", json_fields(F.col("value"))))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Log scan with a known schema; blank and malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def header_name(name: str) -> str:
    return re.sub(r"\s+", "_", name.strip().lower())


def read_csv_events(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """CSV with a header; names are trimmed, lower-cased and joined with underscores."""
    df = spark.read.csv(path, header=True, inferSchema=infer)
    return df.toDF(*[header_name(c) for c in df.columns])


def columns_as_map(df: DataFrame) -> DataFrame:
    """All columns of a row as one ``raw`` map, nulls as empty texts."""
    entries = [x for c in df.columns for x in (F.lit(c), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))]
    return df.select(F.create_map(*entries).alias("raw"))


def line_fields(line: Column) -> Column:
    """A text line: its k=v pairs when there are at least two, else one message."""
    return F.coalesce(text.key_values(line), F.create_map(F.lit("message"), line))


def read_text_events(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_name").alias("source"))
    return wrapped(lines.where("value <> ''").withColumn("raw", line_fields(F.col("value"))))


def wrapped(df: DataFrame, source: Column | None = None, asset: Column | None = None) -> DataFrame:
    """Record wrap: raw map, guessed asset and the source label."""
    label = source if source is not None else (F.col("source") if "source" in df.columns else F.lit("ui-upload"))
    given = asset if asset is not None else F.lit("")
    guessed = F.coalesce(F.when(given != "", given), records.guess_asset(F.col("raw")))
    return df.select(F.col("raw"), guessed.alias("asset_id"), label.alias("source"))


def coerced(cell: Column) -> Column:
    """STRUCT<as_int, as_double, as_text>: the narrowest reading of a cell."""
    whole = F.when(cell.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(cell).try_cast("bigint"))
    real = F.when(whole.isNull(), F.trim(cell).try_cast("double"))
    return F.struct(
        whole.alias("as_int"), real.alias("as_double"), F.when(whole.isNull() & real.isNull(), cell).alias("as_text")
    )


def read_flow_csv(spark: SparkSession, path: str) -> DataFrame:
    """Flow CSV as raw maps; header names keep their leading blanks."""
    df = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=False)
    return columns_as_map(df)


def keyed_objects(doc: DataFrame, key: str, value_schema: str, column: str = "value") -> DataFrame:
    """JSON object keyed by id -> one row per id."""
    return doc.select(F.explode(F.from_json(column, f"map<string,{value_schema}>")).alias(key, "_v")).select(key, "_v.*")


ASSET_SCHEMA = (
    "struct<ip:string,type:string,criticality:string,mission:string,software:array<string>,sector:string,"
    "internet_facing:boolean,safety_critical:boolean,can_reboot:boolean,can_interrupt:boolean,impact_if_compromised:string>"
)
CAMPAIGN_SCHEMA = "struct<description:string,ttp_sequence:array<string>,preventive_actions:map<string,string>>"


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    return keyed_objects(spark.read.text(path, wholetext=True), "asset_id", ASSET_SCHEMA)


def read_campaigns(spark: SparkSession, path: str) -> DataFrame:
    rows = keyed_objects(spark.read.text(path, wholetext=True), "name", CAMPAIGN_SCHEMA)
    return rows.withColumn("campaign_id", F.xxhash64("name"))


def id_list(doc: DataFrame, field: str, name: str, column: str = "value") -> DataFrame:
    """Array field of a JSON object -> a one-column table."""
    parsed = F.from_json(column, f"struct<`{field}`:array<string>>")
    return doc.select(F.explode(parsed[field]).alias(name)).distinct()


def read_corpus_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)
