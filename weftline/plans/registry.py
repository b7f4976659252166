"""Registered queries and their SQL twins, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Lazy access to the driver tables: ``t.documents``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(build):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return build(Tables(spark, folder))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return build
    return register


def r6(col):
    """Double rounded to six digits without negative zero."""
    return F.round(col.cast("double"), 6) + F.lit(0.0)


def joined(col, sep: str = ","):
    """Array of integers or strings as one string."""
    return F.array_join(col.cast("array<string>"), sep)
