"""The query catalogue: every SURVEY §2 operator as a named query over the test
tables, with its oracle SQL (or ``None`` where only a row-count check applies).

Each query is ``f(spark, sf_dir) -> DataFrame``: it reads the derived fact tables
(built by Spark from the given test tables, see ``sources.fixtures``), applies one
operator with the reference's default parameters and rounds doubles to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shockspark.functions.exprs import round_doubles
from shockspark.plans.sqlkit import double_round

Query = Callable[[SparkSession, str], DataFrame]

CATALOG: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add ``fn(spark, sf_dir)`` under ``name`` with its oracle SQL."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir), 6)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        CATALOG[name] = (run, double_round(sql) if sql else None)
        return fn

    return deco


MODULES = ["q_shock", "q_features", "q_io", "q_clean", "q_kpis", "q_travel", "q_series", "q_forecast", "q_stream", "q_store", "q_links"]


def load_all() -> dict[str, tuple[Query, str | None]]:
    """Import every catalogue module (importing registers its queries)."""
    import importlib

    for m in MODULES:
        importlib.import_module(f"shockspark.plans.{m}")
    return CATALOG
