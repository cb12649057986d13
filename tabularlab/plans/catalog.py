"""Registry of named queries: one per operator of the inventory.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables; the
equivalent DuckDB SQL (when SQL can express the operator) sits beside it and is
used as the correctness oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that they register themselves."""
    import importlib
    for mod in ("q_series", "q_relational", "q_aggs", "q_features", "q_text", "q_stats",
                "q_models", "q_io", "q_stream"):
        importlib.import_module(f"tabularlab.plans.{mod}")
