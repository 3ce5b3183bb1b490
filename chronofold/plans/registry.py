"""One place where plan modules put their queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, **kinds: str) -> Callable[[Query], Query]:
    """Register a function as the query of its name. kinds: SQL types of columns whose own type in the SQL is wider than the query's."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            casts = ", ".join(f"{c}::{kind} AS {c}" for c, kind in kinds.items())
            ORACLES[f.__name__] = f"SELECT * REPLACE ({casts}) FROM ({oracle})" if casts else oracle
        return f

    return add
