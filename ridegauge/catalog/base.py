"""Registry of queries with their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


NUDGE = 1e-9  # moves decimal ties off the rounding boundary, so that summation order cannot flip them


def _nudged(sql: str) -> str:
    """The oracle's counterpart of :func:`rounded`; adding 0.0 turns -0.0 into 0.0."""
    return re.sub(r"(,\s*|SELECT\s+|THEN\s+)round\(", r"\g<1>0.0 + round(1e-9 + ", sql)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = _nudged(sql)
        return fn

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison; -0.0 becomes 0.0."""
    return df.select(
        *[
            (F.round(F.col(n) + F.lit(NUDGE), places) + F.lit(0.0)).alias(n) if t in ("double", "float") else F.col(n)
            for n, t in df.dtypes
        ]
    )
