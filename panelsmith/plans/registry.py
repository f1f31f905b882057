"""The named queries, each with the SQL that gives the same rows."""

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


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Build], Build]:
    """Register the decorated function under its own name."""

    def add(build: Build) -> Build:
        if build.__name__ in REGISTRY:
            raise ValueError(f"{build.__name__} is registered twice")
        REGISTRY[build.__name__] = Query(build.__name__, build, sql)
        return build

    return add
