"""Registry of named queries, each with its SQL equivalent where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` must give the same columns and rows on the same tables."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def load_all() -> None:
    from sievegrid.plans import (  # noqa: F401
        queries_epoch,
        queries_evaluation,
        queries_extensions,
        queries_geometry,
        queries_intake,
        queries_ranking,
        queries_sampling,
        queries_sequences,
        queries_similarity,
        queries_sources,
        queries_streaming,
    )
