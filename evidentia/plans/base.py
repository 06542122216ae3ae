"""Registry of named queries with the SQL that a check may run beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder (spark, sf_dir) -> DataFrame; sql gives the same rows where SQL can."""

    def add(build: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} is defined twice")
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return add
