"""The list of queries, filled by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return add


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Sums differ in their last bits between engines; adding 0 removes a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def rsql(x: str, digits: int = 6) -> str:
    return f"(round({x}, {digits}) + 0e0)"
