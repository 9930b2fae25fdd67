"""The registry of named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Named:
    name: str
    run: Query
    sql: str | None


class Catalog:
    """Queries in order of registration; ``sql`` is the DuckDB twin, or None where SQL can't express it."""

    def __init__(self) -> None:
        self.entries: dict[str, Named] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            if name in self.entries:
                raise ValueError(f"query {name} is registered twice")
            self.entries[name] = Named(name, fn, sql)
            return fn

        return register

    def queries(self) -> dict[str, Query]:
        return {n: e.run for n, e in self.entries.items()}

    def oracle_sql(self) -> dict[str, str]:
        return {n: e.sql for n, e in self.entries.items() if e.sql}
