"""How a module registers a query with its oracle statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named queries and, where SQL can state them, their DuckDB statements."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, oracle: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            name = query.__name__
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = query
            if oracle is not None:
                self.oracles[name] = oracle
            return query

        return register
