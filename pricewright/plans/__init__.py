"""All queries of the library, by key, and the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("scalar_queries", "book_queries", "replay_queries", "identity_queries", "feed_queries", "timeline_queries")


def _catalogues():
    return [import_module(f"{__name__}.{m}").C for m in MODULES]


def queries() -> dict:
    return {k: q for c in _catalogues() for k, q in c.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for c in _catalogues() for k, q in c.sql.items()}
