"""Where queries and the SQL that checks them are entered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def checked_by(sql: str) -> Callable[[Query], Query]:
    """Enters a query with its SQL, which is written apart from the engine's expressions."""
    def enter(f: Query) -> Query:
        ORACLES[f.__name__] = sql
        return query(f)

    return enter


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")
