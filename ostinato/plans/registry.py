"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "detect_segments"


def query(sql: str | None = None, name: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def load() -> None:
    from ostinato.plans import catalog_queries, detect_queries, interval_queries, reuse_queries, review_queries, stream_queries, text_queries  # noqa: F401


load()
