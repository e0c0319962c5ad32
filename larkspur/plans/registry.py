"""All registered queries and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.sources.tables import driver_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return driver_table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of :class:`Tables` under a name, with the SQL for the same rows."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def load() -> None:
    """Import the modules that register."""
    from larkspur.plans import catalogue, functions, histories, joins, listings, metrics, pages, relational, streams  # noqa: F401
