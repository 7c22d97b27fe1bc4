"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Engines differ in the last digits of sums; results are compared to six decimals."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
