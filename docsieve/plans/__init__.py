"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from docsieve.plans.registry import QUERIES, SQL, Build

MODULES = ("searching", "counting", "shaping", "editing", "checking", "media", "files")


def _load() -> None:
    for name in MODULES:
        import_module(f"docsieve.plans.{name}")


def all_queries() -> dict[str, Build]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
