"""Query registry and the helpers both sides of a check share."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` function under its own name."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return register


def rounded(df: DataFrame) -> DataFrame:
    """Six decimals, shifted off the rounding tie, for every floating column (checks only, never operators)."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        cols.append((F.round(c + 1.7e-8, 6) + 0.0).alias(name) if kind in ("double", "float") else c)
    return df.select(*cols)


def r(expr: str, name: str | None = None) -> str:
    """The same rounding in SQL."""
    return f"round(CAST({expr} AS DOUBLE) + 1.7E-8, 6) + 0.0E0 AS {name or expr}"


def rs(names: Iterable[str], prefix: str = "") -> str:
    return ", ".join(r(f"{prefix}{n}", n) for n in names)


def big(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {name or expr}"
