"""Query registry and access to the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vigilframe.session import configure


class Tables:
    """Lazy access to the parquet tables of one data folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = str(path).rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, path: str) -> DataFrame:
        return self.build(Tables(configure(spark), path))


REGISTRY: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register a query; ``covers`` lists the inventory ids it exercises."""

    def add(fn: Callable[[Tables], DataFrame]):
        if fn.__name__ in REGISTRY:
            raise ValueError(f"query {fn.__name__} registered twice")
        REGISTRY[fn.__name__] = Query(fn.__name__, tuple(covers.split()), fn, sql)
        return fn

    return add


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Select expressions written in the common SQL subset."""
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


def select_sql(table: str, columns: dict[str, str]) -> str:
    """The same projection as SQL text."""
    return "SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in columns.items()) + f" FROM {table}"
