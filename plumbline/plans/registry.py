"""Registration of runnable queries together with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.plans.oracle import with_ctes
from plumbline.sources.adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, uses: tuple[str, ...] = (), sql: str | None = None, recursive: bool = False):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_ctes(sql, uses, recursive)
        return fn
    return register


def steady(x: Column | str) -> Column:
    """Thousandths, cut at points that are no decimal fractions.

    Sums of doubles differ in the last bit with the order of addition, and prices often end on an
    exact half of the last shown digit; cutting elsewhere keeps both engines on the same side.
    """
    col = F.col(x) if isinstance(x, str) else x
    return F.floor(col * 1000.0 + 0.3718281828) / 1000.0


def steady_sql(expr: str) -> str:
    return f"floor(({expr})*1000.0::DOUBLE + 0.3718281828::DOUBLE)/1000.0::DOUBLE"
