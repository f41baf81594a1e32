"""Registered queries: each name has a Spark builder and, where SQL can say it, an equal SQL text."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def load() -> None:
    from threadgraph.catalog import (  # noqa: F401
        corpus, evaluation, graphs, iterative, paths, similarity, sources, texts,
    )
