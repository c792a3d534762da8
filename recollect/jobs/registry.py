"""The library's registered queries, by name, and their SQL."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "bm25_search"
MODULES = ("enumeration", "retrieval", "revision", "graph", "traces", "consolidation", "evaluation", "embeddings")
_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its own name, with its SQL if there is any."""

    def register(function):
        _QUERIES[function.__name__] = function
        if sql:
            _SQL[function.__name__] = sql
        return function

    return register


def _load() -> None:
    for module in MODULES:
        import_module(f"recollect.jobs.{module}")


def queries() -> dict:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
