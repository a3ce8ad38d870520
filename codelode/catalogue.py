"""Name -> query catalogue. Registering the same name twice is an error."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    def __init__(self) -> None:
        self._queries: dict[str, Query] = {}
        self._sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(function: Query) -> Query:
            if name in self._queries:
                raise ValueError(f"query {name!r} is already registered")
            self._queries[name] = function
            if sql is not None:
                self._sql[name] = sql
            return function

        return register

    def queries(self) -> dict[str, Query]:
        return dict(self._queries)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self._sql)


CATALOGUE = Catalogue()
