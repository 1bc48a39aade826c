"""Registered queries, each with its SQL twin."""

from __future__ import annotations

from importlib import import_module

from .base import QUERIES, SQL, Query

MODULES = ("feature_queries", "core_queries", "metric_queries", "portfolio_queries", "source_queries")


def _load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
