"""Daily sketches of distinct counts and quantiles that roll up to any range of days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_K = 14                     # HyperLogLog with 2^14 cells: relative standard error 1.04 / 2^7
RANKS = 400                    # the quantile sketch's k: rank error below 1 % with 99 % confidence


def distinct_error(log_k: int = LOG_K, deviations: float = 4.0) -> float:
    """Relative error that an estimate keeps but for one group in ten thousand."""
    return deviations * 1.04 / 2 ** (log_k / 2)


def daily_sketches(df: DataFrame, day: str, by: Sequence[str], counted: str, measured: str, log_k: int = LOG_K) -> DataFrame:
    """One row per day and group: rows, a sketch of the distinct ``counted`` values and one of ``measured`` values.

    A sketch has a bounded size, so the table grows with days and groups, not with rows, and partial sketches merge
    before the shuffle. Null values enter neither sketch.
    """
    return df.groupBy(day, *by).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(counted), F.lit(log_k)).alias("distinct_sketch"),
                                    F.kll_sketch_agg_double(F.col(measured).cast("double"), F.lit(RANKS)).alias("quantile_sketch"))


def roll_up(sketches: DataFrame, by: Sequence[str], days: Column, probs: Sequence[float] = (0.5,)) -> DataFrame:
    """Rows, distinct values and quantiles per group over the days that meet ``days``; column ``q0`` .. per probability."""
    merged = sketches.filter(days).groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("_d"), F.kll_merge_agg_double("quantile_sketch").alias("_q"))
    return merged.select(*by, "n", F.hll_sketch_estimate("_d").alias("n_distinct"),
                         *[F.kll_sketch_get_quantile_double("_q", F.lit(p)).alias(f"q{i}") for i, p in enumerate(probs)])


def exact(df: DataFrame, by: Sequence[str], counted: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_exact"), F.countDistinct(counted).alias("distinct_exact"))
