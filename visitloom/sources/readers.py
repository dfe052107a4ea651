"""Readers: dated session shards, delimited dumps, Parquet, JSON, spreadsheet XML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.sources.schemas import conform, fields

OPEN_END = 99999999


def scan_sessions(df: DataFrame, ranges, dt: str = "dt") -> DataFrame:
    """Rows whose ``yyyyMMdd`` shard lies in any of the ranges ``a``, ``[a]`` or ``[a, b]``.

    A bound of zero or less is an open end, bounds may come in either order, and intraday shards
    (``intraday_yyyyMMdd``) are included. On a table partitioned by ``dt`` this prunes partitions.
    """
    conds = []
    for r in ranges:
        bounds = list(r) if hasattr(r, "__iter__") else [r]
        if len(bounds) not in (1, 2) or any(type(b) is not int for b in bounds):
            raise ValueError(f"a range is one or two ints, got {r!r}")
        bounds = [b if b > 0 else OPEN_END for b in bounds]
        lo, hi = f"{min(bounds):08d}", f"{max(bounds):08d}"
        conds += [F.col(dt).between(lo, hi), F.col(dt).between(f"intraday_{lo}", f"intraday_{hi}")]
    return df.filter(reduce(lambda a, b: a | b, conds, F.lit(False)))


def read_dump(spark: SparkSession, path: str, ddl: str, sep: str = ";", header: bool = False,
              compressed_whole: bool = False, parts: int | None = None) -> DataFrame:
    """Delimited dump with declared names and types; gzip is recognised by extension.

    A gzip file is one task per file; ``parts`` spreads the rows right after reading.
    """
    df = spark.read.schema(", ".join(f"`{n}` string" for n, _ in fields(ddl))).csv(path, sep=sep, header=header, quote='"', escape="\\")
    df = conform(df, fields(ddl))
    return df.repartition(parts) if parts else df


def read_table(spark: SparkSession, path: str, columns=None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_payload(spark: SparkSession, path: str, ddl: str, fmt: str = "json") -> DataFrame:
    """Scoring payload with a declared schema."""
    reader = spark.read.schema(ddl)
    return reader.json(path) if fmt == "json" else reader.csv(path, header=True)


def parse_payload(df: DataFrame, column: str, ddl: str) -> DataFrame:
    """Scoring payloads held as JSON text in a column."""
    return df.select(F.from_json(column, ddl).alias("p")).select("p.*")


def read_study(spark: SparkSession, path: str, columns: list[str], flag: str) -> DataFrame:
    """Rows of spreadsheet-XML files below their header row, with a flag taken from the file name.

    ``columns`` are the header names; header rows are recognised by repeating them.
    """
    cell = "struct<Data:string>"
    rows = (spark.read.option("rowTag", "Row").option("ignoreNamespace", "true")
            .schema(f"Cell array<{cell}>").xml(path)
            .select(F.col("Cell.Data").alias("c"), F.input_file_name().alias("_file")))
    named = rows.select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(columns)],
                        F.contains(F.lower(F.element_at(F.split("_file", "/"), -1)), F.lit(flag)).alias("is_flagged"))
    return named.filter(F.coalesce(F.col(columns[0]), F.lit("")) != columns[0])


def latest_run(runs: DataFrame, name: str) -> DataFrame:
    """The run whose name carries the newest ``YYYY-MM-DD-HH-MM-SS`` stamp."""
    stamp = F.try_to_timestamp(F.nullif(F.regexp_extract(F.col(name), r"(\d{4}-\d{2}-\d{2}-\d{2}-\d{2}-\d{2})", 1), F.lit("")),
                               F.lit("yyyy-MM-dd-HH-mm-ss"))
    return runs.select(F.col(name).alias("run"), stamp.alias("at")).agg(
        F.max_by("run", "at").alias("run"), F.max("at").alias("at"))


def resume_queue(items: DataFrame, done: DataFrame, key: str, status: str = "status") -> DataFrame:
    """Earlier results are kept; items not seen before are ``pending``."""
    new = items.select(key).distinct().join(done, key, "left_anti").withColumn(status, F.lit("pending"))
    return done.select(key, status).unionByName(new)
