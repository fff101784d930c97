"""Registration of queries with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.fixtures import Tables, duckdb_sql

BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, build: Callable[[Tables], DataFrame], oracle: str | None = None) -> None:
    """Register ``build`` (tables -> result) and the SQL text that must give the same rows."""
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    BUILDERS[name] = build
    QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
    if oracle is not None:
        ORACLES[name] = duckdb_sql(oracle)


def query(name: str, oracle: str | None = None):
    """Decorator form of :func:`register`."""

    def wrap(build):
        register(name, build, oracle)
        return build

    return wrap
