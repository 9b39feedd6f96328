"""Inputs shared by the queries.

A stand-in is one SELECT that both Spark and DuckDB accept; it derives the rows
an operator needs from the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    """Run a stand-in SELECT; tables are written as {name}."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in select}
    return spark.sql(select, **used)


def plain(select: str) -> str:
    """The same SELECT with bare table names."""
    for t in TABLES:
        select = select.replace("{" + t + "}", t)
    return select


class Registry:
    """Named queries with their SQL, filled by the modules of this package."""

    def __init__(self):
        self.queries = {}
        self.oracles = {}

    def add(self, name: str, oracle: str | None = None):
        def register(fn):
            assert name not in self.queries, name
            self.queries[name] = fn
            if oracle is not None:
                self.oracles[name] = oracle
            return fn

        return register
