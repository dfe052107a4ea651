"""Physical layout: bytes a query reads by column, partition upserts, bucketed tables."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.session import store
from visitloom.sources.writers import readable_size

_FILTER = re.compile(r"(EqualTo|GreaterThan|GreaterThanOrEqual|LessThan|LessThanOrEqual)\(([^,()]+),([^()]*)\)")


def _may_hold(op: str, low, high, text: str) -> bool:
    """Whether a row group with these bounds may hold a match; true if the bounds cannot be compared."""
    try:
        v = dt.date.fromisoformat(text) if isinstance(low, dt.date) and not isinstance(low, dt.datetime) else type(low)(text)
        return {"EqualTo": low <= v <= high, "GreaterThan": high > v, "GreaterThanOrEqual": high >= v,
                "LessThan": low < v, "LessThanOrEqual": low <= v}[op]
    except (TypeError, ValueError, ArithmeticError):
        return True


def _footers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bytes of the columns that each file's scan reads, from its footer alone."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    for frame in frames:
        sizes = []
        for path, columns, filters in zip(frame["path"], frame["columns"], frame["filters"]):
            system, at = fs.FileSystem.from_uri(path)
            meta = pq.read_metadata(system.open_input_file(at))
            total, wanted, tests = 0, set(columns), _FILTER.findall(filters)
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                chunks = [group.column(i) for i in range(group.num_columns)]
                stats = {c.path_in_schema: c.statistics for c in chunks if c.statistics is not None and c.statistics.has_min_max}
                if all(_may_hold(op, stats[c].min, stats[c].max, v) for op, c, v in tests if c in stats):
                    total += sum(c.total_compressed_size for c in chunks if c.path_in_schema.split(".")[0] in wanted)
            sizes.append(total)
        yield pd.DataFrame({"path": frame["path"], "bytes": sizes})


def _each(iterator) -> Iterator:
    while iterator.hasNext():
        yield iterator.next()


def column_bytes(df: DataFrame) -> int:
    """Bytes of the Parquet column chunks that the query reads, after pruning of partitions, columns and row groups.

    The scans of the physical plan name their files, columns and pushed filters; the tasks read the files' footers,
    and nothing of the data. Row groups are pruned by simple comparisons on their bounds. A file that several
    scans read counts for each. Files must lie in a store that pyarrow can open.
    """
    spark = df.sparkSession
    rows = []
    for leaf in _each(df._jdf.queryExecution().sparkPlan().collectLeaves().iterator()):
        if "FileSourceScan" not in leaf.getClass().getSimpleName():
            continue
        columns = list(leaf.requiredSchema().fieldNames())
        pushed = leaf.metadata().get("PushedFilters")
        for listed in _each(leaf.selectedPartitions().filePartitionIterator()):
            for file in _each(listed.files()):
                rows.append((file.getPath().toString(), columns, pushed.get() if pushed.isDefined() else ""))
    if not rows:
        return 0
    files = spark.createDataFrame(rows, "path string, columns array<string>, filters string")
    found = files.repartition(min(len(rows), 10_000)).mapInPandas(_footers, "path string, bytes long")
    return found.agg(F.sum("bytes")).first()[0] or 0


def check_column_scan(df: DataFrame, limit_bytes: int) -> DataFrame:
    """Return ``df`` unchanged, or raise when the columns it reads hold more than the limit."""
    n = column_bytes(df)
    if n > limit_bytes:
        size, prefix = readable_size(n)
        raise ValueError(f"the query would read {size:.1f} {prefix}B")
    return df


def upsert_partitions(new: DataFrame, path: str, partition: str, keys: Sequence[str], order: Column | None = None) -> int:
    """Replace or add the rows of ``new`` in a partitioned Parquet table; returns how many partitions it rewrote.

    Only partitions that ``new`` touches are written (dynamic overwrite); all others keep their files. A row with the
    keys of an old one replaces it. Conflicts raise before anything is written: keys that ``new`` holds twice
    (unless ``order`` says which row is the latest), and keys whose old row lies in another partition.
    """
    spark = new.sparkSession
    if order is not None:
        latest = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), order).alias("_row"))
        new = latest.select("_row.*")
    new = store(new)
    if new.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError("the new rows hold a key twice")
    exists = _exists(spark, path)
    if not exists:
        new.write.partitionBy(partition).parquet(path)
        return new.select(partition).distinct().count()
    old = spark.read.parquet(path)
    old = old.withColumn(partition, F.col(partition).cast(new.schema[partition].dataType))
    moved = old.join(new.select(*keys, F.col(partition).alias("_to")), list(keys)).filter(~F.col(partition).eqNullSafe(F.col("_to")))
    if moved.limit(1).count():
        raise ValueError("a key's old row lies in another partition")
    touched = store(new.select(partition).distinct())
    kept = old.join(touched, partition, "left_semi").join(new.select(*keys), list(keys), "left_anti").select(*new.columns)
    merged = store(kept.unionByName(new))                     # the old files are read before they are replaced
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return touched.count()


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def save_bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int, sort: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """Write a table in buckets of its keys, sorted inside, and read it back.

    Tables with the same number of buckets join and aggregate on the keys without an exchange. Rows are dealt to the
    buckets' tasks first, so a bucket is one file.
    """
    w = df.repartition(buckets, *keys).write.mode("errorifexists").bucketBy(buckets, *keys).sortBy(*(sort or keys))
    (w.option("path", path) if path else w).saveAsTable(table)
    return df.sparkSession.table(table)
