"""Every query of the core, by name, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scholion.plans import analytics, entities, extraction, graphs, lookups, merges, orphans, quality, retrieval, streams, writers

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (analytics, quality, merges, entities, extraction, lookups, writers, graphs, retrieval, streams, orphans)


def queries() -> dict[str, Query]:
    """All core queries."""
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def sql() -> dict[str, str]:
    """The SQL of the core queries that SQL can express."""
    return {name: text for module in MODULES for name, text in module.SQL.items()}
