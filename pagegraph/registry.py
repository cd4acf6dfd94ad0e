"""A module's queries and the SQL that checks them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Keys of a task that makes a text of each and parses it.
DEALT = 5000


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query; sql is its twin in DuckDB's dialect, None where SQL can't say it."""

        def put(query: Query) -> Query:
            self.queries[name] = query
            if sql:
                self.oracles[name] = sql
            return query

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """The key of a table, in equal parts of at most about DEALT rows, for queries that make a text of each key and parse it.

    Files are split by bytes and at row groups, so millions of keys would be a task or two, however long their texts
    take. Only keys are moved. The number of rows comes from the files' footers.
    """
    keys = table(spark, sf_dir, name).select(key)
    parts = math.ceil(keys.count() / DEALT)
    return keys.repartition(parts) if parts > 1 else keys
