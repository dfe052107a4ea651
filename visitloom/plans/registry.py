"""The registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.plans.inputs import Tables

RUN: dict[str, Callable[[Tables], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in RUN:
            raise ValueError(f"{name} is registered twice")
        RUN[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def entry_point(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Tables(spark, sf_dir))


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so that summation order does not show."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


def as_text(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in cols})


def as_int(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})
