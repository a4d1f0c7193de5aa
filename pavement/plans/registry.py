"""Where check queries register themselves together with their SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pavement.plans.bindings import Bindings, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: dict[str, str] | None = None):
    """Register a function of the bindings; without ``sql`` only rows are checked."""

    def register(build: Callable[[Bindings], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Bindings(spark, folder))
        if sql is not None:
            SQL[name] = with_views(sql, ctes)
        return build

    return register
