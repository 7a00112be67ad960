"""Registered queries: a Spark callable and (where SQL can say it) a DuckDB oracle.

Every query reads the given tables (or views Spark derives from them) whole.
Double results are rounded the same way on both sides so the oracle compare
is not at the mercy of summation order; the rounding scale follows the
magnitude of the value (bounded scores 6 decimals, squared errors 2).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql.strip() if sql else None)
        return fn

    return deco


def load_all() -> dict[str, Query]:
    # importing the modules fills REGISTRY
    from scorewell.plans import (  # noqa: F401
        q_boosting,
        q_features,
        q_leaderboard,
        q_metrics,
        q_models,
        q_profile,
        q_selection,
        q_streaming,
    )

    return REGISTRY
