"""Sinks: exports, unloads, table loads, retention, run artifacts, scan-size guard."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET_BYTES = 100_000_000


def export_table(df: DataFrame, path: str, fmt: str = "csv", header: bool = False) -> None:
    """Gzip CSV, gzip JSON lines, or Avro when its package is on the class path."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("compression", "gzip").option("header", header).csv(path)
    elif fmt == "json":
        w.option("compression", "gzip").json(path)
    elif fmt == "avro":
        w.format("avro").save(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def unload(df: DataFrame, path: str, sep: str = ";", header: bool = False, quote_all: bool = True,
           compression: str = "gzip", mode: str = "overwrite", single_file: bool = False) -> None:
    """Parallel delimited unload. ``single_file`` is for small reports: it writes through one task."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).csv(path, sep=sep, header=header, quoteAll=quote_all, escape="\\", compression=compression)


def write_header(df: DataFrame, path: str, sep: str = ";") -> None:
    """The header line alone, next to a header-less unload."""
    df.limit(0).coalesce(1).write.mode("overwrite").csv(path, sep=sep, header=True)


def convert(df: DataFrame, path: str, fmt: str = "parquet", input_bytes: int | None = None,
            target_bytes: int = TARGET_BYTES) -> None:
    """Rewrite in another format with files of about ``target_bytes``."""
    if input_bytes:
        df = df.repartition(max(1, math.ceil(input_bytes / target_bytes)))
    df.write.mode("overwrite").format(fmt).save(path)


def load_table(df: DataFrame, table: str, mode: str = "errorifexists", path: str | None = None, partition_by=()) -> None:
    """``overwrite``, ``append`` or ``errorifexists``; ``path`` places the files outside the warehouse."""
    if mode not in ("overwrite", "append", "errorifexists"):
        raise ValueError(mode)
    w = df.write.mode(mode)
    w = w.partitionBy(*partition_by) if partition_by else w
    (w.option("path", path) if path else w).saveAsTable(table)


def query_to_table(spark: SparkSession, query: str, table: str, overwrite: bool = True, path: str | None = None) -> None:
    """Materialise a query; without ``overwrite`` a non-empty destination is an error."""
    if not overwrite and spark.catalog.tableExists(table) and not spark.table(table).isEmpty():
        raise ValueError(f"{table} is not empty")
    load_table(spark.sql(query), table, "overwrite", path)


def drop_if_exists(spark: SparkSession, *tables: str) -> None:
    for t in tables:
        spark.sql(f"DROP TABLE IF EXISTS {t}")


# Size prefixes, base 1024.
PREFIXES = ["", "k", "M", "G", "T", "P", "E", "Z", "Y"]


def readable_size(value: float) -> tuple[float, str]:
    order = 0
    while order < len(PREFIXES) - 1 and value >= 1024 ** (order + 1):
        order += 1
    return value / 1024 ** order, PREFIXES[order]


def scan_bytes(df: DataFrame) -> int:
    """Bytes in the files a query would read, after partition pruning."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    total = 0
    for name in df.inputFiles():
        p = jvm.org.apache.hadoop.fs.Path(name)
        total += p.getFileSystem(conf).getFileStatus(p).getLen()
    return total


def check_scan(df: DataFrame, limit_bytes: int) -> DataFrame:
    """Return ``df`` unchanged, or raise when it would read more than the limit."""
    n = scan_bytes(df)
    if n > limit_bytes:
        size, prefix = readable_size(n)
        raise ValueError(f"the query would read {size:.1f} {prefix}B")
    return df


def set_expiry(spark: SparkSession, table: str, when: str | None) -> None:
    """Record when a table expires (``yyyy-MM-dd``); ``None`` clears it."""
    if when is None:
        spark.sql(f"ALTER TABLE {table} UNSET TBLPROPERTIES IF EXISTS ('expires_at')")
    else:
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('expires_at' = '{when}')")


def sweep_expired(spark: SparkSession, tables, today: str) -> list[str]:
    """Drop the listed tables whose expiry lies before ``today``."""
    dropped = []
    for t in tables:
        props = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {t}").collect()}
        if props.get("expires_at", "9999-12-31") < today:
            drop_if_exists(spark, t)
            dropped.append(t)
    return dropped


def drop_partitions_before(spark: SparkSession, table: str, column: str, first_kept: str) -> list[str]:
    """Drop the partitions of a dated table before a day, files included; returns their values."""
    old = [r["partition"].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    old = sorted(v for v in old if v < first_kept)
    for value in old:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({column} = '{value}') PURGE")
    return old


def save_artifacts(model, metrics: dict[str, float], tables: dict[str, DataFrame], folder: str, model_id: str,
                   spark: SparkSession) -> None:
    """Model, metrics and result tables of one run under ``folder/model_id``."""
    base = f"{folder}/{model_id}"
    if model is not None:
        model.write().overwrite().save(f"{base}/model")
    row = spark.createDataFrame([(model_id, {k: float(v) for k, v in metrics.items()})],
                                "model_id string, metrics map<string,double>")
    row.coalesce(1).write.mode("overwrite").json(f"{base}/metrics")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")


def image_url(c: str):
    """Give a bare URL its scheme, dropping its first empty path segment."""
    u = F.col(c)
    bare = (F.when(u.startswith("/"), F.substring(u, 2, 1 << 30))
            .when(u.contains("//"), F.regexp_replace(u, "^(.*?)//", "$1/"))
            .when(u.endswith("/"), F.regexp_replace(u, "/$", "")).otherwise(u))
    return F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("http://"), bare))


def image_views(df: DataFrame, c: str, views: int = 4) -> DataFrame:
    numbers = F.sequence(F.lit(1), F.lit(views))
    return df.withColumn("view_url", F.explode(F.transform(
        numbers, lambda i: F.replace(F.col(c), F.lit("1-"), F.concat(i.cast("string"), F.lit("-"))))))
