"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None
    operators: str


QUERIES: dict[str, Query] = {}


def query(name: str, operators: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query; without ``sql`` it is checked by fixtures in the tests only."""
    def add(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, sql, operators)
        return build
    return add
