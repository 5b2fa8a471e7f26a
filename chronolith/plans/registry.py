"""Queries over the given tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; its doubles are rounded as R rounds them."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(F.nanvl(c.cast("double"), F.lit(None).cast("double")), 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at 6 places, NaN as null, -0.0 as 0.0."""
    return df.select(*[r6(F.col(f"`{n}`")).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes])


def R(x: str, name: str | None = None) -> str:  # noqa: N802
    """SQL of a rounded double."""
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0" + (f" AS {name}" if name else "")
