"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame`` and, when
the result is SQL-expressible, the equivalent DuckDB SQL over the driver's tables.

Column names are identical on both sides; computed doubles are rounded the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from canframes.plans import (  # noqa: F401
        q_checks,
        q_clean,
        q_metrics,
        q_models,
        q_neural,
        q_newton,
        q_scale,
        q_sequence,
        q_sources,
        q_split,
        q_streaming,
        q_trees,
        q_wide,
    )
