"""The book of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import Views, oracle

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    """Collects queries and their oracle SQL under one name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None, *views: str, extra: dict[str, str] | None = None):
        """Registers a function of ``Views`` under its name; ``sql`` may use the named views."""

        def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
            name = f.__name__
            self.queries[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
            if sql is not None:
                self.oracle[name] = oracle(sql, *views, extra=extra)
            return f

        return add
