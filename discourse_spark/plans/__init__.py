"""Registered queries over the test tables, with their SQL counterparts."""

from __future__ import annotations

from importlib import import_module

AREAS = [
    "text_queries", "analytics_queries", "temporal_queries", "sampling_queries", "model_queries",
    "source_queries",
]


def _load() -> None:
    for area in AREAS:
        import_module(f"{__name__}.{area}")


def all_queries():
    from discourse_spark.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_sql():
    from discourse_spark.plans.registry import SQL

    _load()
    return dict(SQL)
