"""Named queries over the driver's tables, each next to its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register a query; ``check`` is the equivalent SQL on the same tables."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if check is not None:
            ORACLES[name] = check.strip()
        return fn

    return add
