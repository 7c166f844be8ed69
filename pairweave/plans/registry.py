"""Queries by name, each with its DuckDB twin where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: str | Column) -> Column:
    """To six places, and never minus zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + 0.0


def quick_r6(x: str) -> Column:
    """``r6`` of doubles without a decimal number for each value, for rows of all pairs; halves as the SQL has them."""
    v = F.col(x)
    whole = F.floor(F.abs(v) * 1e6 + 0.5).cast("double")
    return F.when(F.abs(v) < 1e9, F.signum(v) * whole / 1e6).otherwise(v) + 0.0


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})
