"""Registry of named queries: a Spark callable plus (optionally) DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from tripletframe.sources.fixtures import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: Sequence[str] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return deco


def load_all():
    """Import every plan module so that their queries register."""
    from tripletframe.plans import (  # noqa: F401
        column_queries,
        flagship,
        mixing_queries,
        scoring_queries,
        source_queries,
        stats_queries,
        stream_queries,
        triplet_queries,
    )
    return QUERIES, ORACLES
