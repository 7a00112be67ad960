"""K3: lift a plain Python row function into a feature column.

Prefer a native Column expression (see ``sequence.py``); when none fits, the
function runs Arrow-batched in a pandas UDF — one Python call per batch of
rows, never a per-row UDF.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

FEATURES: dict[str, Callable[..., Column]] = {}


def lift(fn: Callable, return_type: str = "double", vectorized: bool = False) -> Callable[..., Column]:
    """``fn(value) -> value`` (or ``fn(pd.Series) -> pd.Series`` when vectorized) as a column function."""
    if vectorized:
        return F.pandas_udf(fn, return_type)

    def batch(s: pd.Series) -> pd.Series:
        return s.map(fn)

    return F.pandas_udf(batch, return_type)


def register_feature(
    name: str, fn: Callable, return_type: str = "double", vectorized: bool = False, spark: SparkSession | None = None
) -> Callable[..., Column]:
    """Add a named feature function usable as ``FEATURES[name](col)``; with a session, also in its SQL as ``name(col)``."""
    FEATURES[name] = lift(fn, return_type, vectorized)
    if spark is not None:
        spark.udf.register(name, FEATURES[name])
    return FEATURES[name]


def register_native(spark: SparkSession, name: str, parameter: str, body: str, return_type: str = "double", kind: str = "string") -> None:
    """A feature written in SQL as a session function: Catalyst inlines its body, so its type is known and no Python runs."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameter} {kind}) RETURNS {return_type} RETURN {body}")
