"""Registering a query: its DataFrame function over the tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .views import Tables, with_views

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
MODULE: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Decorates f(t: Tables) -> DataFrame. views are put in front of sql."""

    def put(f: Callable[[Tables], DataFrame]):
        MODULE[name] = f.__module__
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql, *views)
        return f

    return put
