"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.fixtures import WITH
from tessera.plans.graph import PropertyGraph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a graph as a query; sql goes on after the graph's tables."""

    def put(f: Callable[[PropertyGraph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(PropertyGraph.kept(spark, sf_dir))
        if sql:
            ORACLES[name] = f"{WITH} {sql}"
        return f

    return put


def many(*rows: tuple[str, Callable[[PropertyGraph], DataFrame], str | None]) -> None:
    for name, f, sql in rows:
        query(name, sql)(f)


def table_query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) over the base tables."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


COLS = ("id", "kind", "name", "qualified_name", "file_path", "start_line", "is_exported", "docstring")
SLIM = ("id", "kind", "name", "file_path")
ALL, FEW = ", ".join(COLS), ", ".join(SLIM)


def slim(df: DataFrame) -> DataFrame:
    return df.select(*SLIM)


def sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)
