"""Flat schema strings and the helper that makes a table conform to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fields(ddl: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a flat schema string."""
    return [tuple(part.strip().split(" ", 1)) for part in ddl.split(",")]


def conform(df: DataFrame, schema: list[tuple[str, str]]) -> DataFrame:
    """Rename by position, then cast; a value that does not parse becomes null."""
    if len(df.columns) != len(schema):
        raise ValueError(f"expected {len(schema)} columns, got {len(df.columns)}")
    renamed = df.toDF(*[n for n, _ in schema])
    return renamed.select(*[F.col(n).try_cast(t).alias(n) for n, t in schema])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing floats are nulls everywhere in this library."""
    cols = {c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(cols) if cols else df
