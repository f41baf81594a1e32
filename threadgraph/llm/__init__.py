"""Operators of a training-data pipeline; nothing else in the library imports this package."""

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
    from threadgraph.llm import (  # noqa: F401
        bpe, chat, decontaminate, jaccard, kdtree, lm, pii, quality, secrets, taat, trie, urls, warc,
    )
