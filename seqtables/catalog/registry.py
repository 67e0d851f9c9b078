"""Register queries next to the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqtables.catalog import fixtures
from seqtables.session import spread

HEAVY = ("documents", "lineitem", "embeddings")  # row work outweighs a shuffle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Base tables by attribute and fixture views by call, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        if name in fixtures.BASE_TABLES:
            scan = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(scan) if name in HEAVY else scan
        text, sources = fixtures.FIXTURES[name]
        return self.spark.sql(text, **{source: self.table(source) for source in sources})


def query(sql: str | None = None, name: str | None = None):
    """Register ``f(tables) -> DataFrame``; ``sql`` names fixtures in braces like the views do."""

    def register(function: Callable[[Tables], DataFrame]):
        key = name or function.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            ORACLES[key] = fixtures.duckdb_sql(sql)
        return function

    return register
