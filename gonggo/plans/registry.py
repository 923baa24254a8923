"""Named queries over the star-schema tables, each with its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None, **types: tuple[str, ...]) -> Callable[[Query], Query]:
    """Registers a query; `sql` gives the same rows, where SQL can say it.

    `types` names result columns whose SQL type is to be cast: BIGINT=("n",).
    """
    if sql and types:
        casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for t, names in types.items() for c in names)
        sql = f"SELECT * REPLACE ({casts}) FROM ({sql})"

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = sql
        return fn
    return register
