"""Corpus pipeline: toxicity filter, near duplicates, repeated lines, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``docs`` (the last one its packing table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilframe.llm.jaccard import one_of_each_group
from vigilframe.llm.lines import RUN_WORDS, deduplicated
from vigilframe.llm.mixing import thinned
from vigilframe.llm.packing import packed
from vigilframe.llm.toxicity import without_toxic
from vigilframe.session import configure, scratch_path


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/labels.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts scored toxic at the threshold go; labels are learned from outside the held-out fold."""
    return without_toxic(docs, _labels(configure(spark), sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, links from 80 %; the smallest doc_id of each group stays."""
    configure(spark)
    return one_of_each_group(docs, width=5, percent=80)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All but the earliest occurrence of each repeated run of lines, sentences and clauses of 40 words or more is cut; a document left without words goes."""
    configure(spark)
    return deduplicated(docs, "run", RUN_WORDS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Junk and toxic words are thinned to their target share; clean documents stay."""
    return thinned(docs, _labels(configure(spark), sf_dir))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return packed(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_lines", repeated_lines),
    ("mixing", mixing),
    ("packing", packing),
]

# Trained models and connected components are no SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written below the shared folder and read again."""
    configure(spark)
    docs = spark.read.parquet(f"{str(sf_dir).rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
