"""Name -> (Spark query, equivalent SQL)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}

FAMILIES = (
    "factors",
    "panels",
    "signals",
    "portfolio",
    "metrics",
    "cleaning",
    "quality",
    "contract",
    "lookups",
    "vendors",
    "storage",
    "generated",
    "flows",
)


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"panelkite.catalog.{family}")


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Round so that engines with different summation orders agree.

    The small offset moves exact decimal ties off the rounding boundary; adding zero drops the
    sign of -0.0. `r` is the same in SQL.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(float(f"1.23e-{digits + 3}")), digits) + F.lit(0.0)


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr} + 1.23e-{digits + 3}, {digits}) + 0.0::DOUBLE)"
