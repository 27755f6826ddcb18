"""Registration of catalogue queries."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

#: What the views of driver tables are named with.
VIEW_PREFIX = "chartula_"

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Driver tables by attribute: ``Tables(spark, folder).documents``.  Each is looked up once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._found: dict[str, DataFrame] = {}
        # Views of each folder have names of their own, and leave the session's alone.
        self._prefix, self._views = f"{VIEW_PREFIX}{zlib.crc32(folder.encode())}_", set()

    def sql(self, statement: str, *names: str) -> DataFrame:
        """A statement over driver tables."""
        for name in names:
            statement = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {self._prefix}{name}", statement)
            if name not in self._views:
                getattr(self, name).createOrReplaceTempView(self._prefix + name)
                self._views.add(name)
        return self.spark.sql(statement)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._found:
            self._found[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._found[name]


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name`` with its DuckDB counterpart."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
