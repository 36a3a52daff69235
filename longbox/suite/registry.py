"""Where suite modules put their queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from longbox.plans import bindings
from longbox.session import configure

QueryFunction = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The bound tables of one folder, read lazily by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return bindings.frame(self.spark, self.folder, name)


class Suite:
    def __init__(self) -> None:
        self.queries: dict[str, QueryFunction] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Register ``fn(tables) -> DataFrame``; ``sql`` may use bound names."""

        def wrap(fn: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, folder: fn(Tables(spark, folder))
            if sql is not None:
                self.oracles[name] = bindings.with_ctes(sql)
            return fn

        return wrap
