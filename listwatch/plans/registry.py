"""Registry of the named queries: a Spark builder plus, where the query is
expressible in plain SQL, the DuckDB oracle used by the correctness check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    oracle: str | None
    operators: tuple[str, ...]


_QUERIES: dict[str, Query] = {}


def register(name: str, operators: str, oracle: str | None = None):
    """Decorator: ``@register("key", "J1 P3", oracle=SQL)``."""

    def deco(fn: Builder) -> Builder:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        _QUERIES[name] = Query(name, fn, oracle, tuple(operators.split()))
        return fn

    return deco


def all_queries() -> dict[str, Query]:
    # importing the plan modules fills the registry
    from listwatch.plans import (  # noqa: F401
        matching, listing_state, crawl, alerts, runs, entitlements, pages, catalog, reports, ordering, streams,
    )
    return dict(_QUERIES)
