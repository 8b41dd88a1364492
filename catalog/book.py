"""One place where every query is entered with its check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def enter(name: str, query: Query, check: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is entered twice")
    QUERIES[name] = query
    if check is not None:
        CHECKS[name] = check
