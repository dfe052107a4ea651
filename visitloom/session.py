"""Session settings the library relies on, and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_stored: dict[str, list[str]] = {}                 # by application: folders written by ``store``
_named: dict[tuple[str, str], DataFrame] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Set the SQL options every job here assumes. Cluster sizing stays with the submitter."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Split a hot join key even when that costs one more exchange above the join.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a scratch one only for local runs with none configured."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="visitloom-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return sc.getCheckpointDir()


def store(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write a wide intermediate table once, as Parquet next to the checkpoints, and read it back.

    Later readers prune columns and know its size, which a checkpoint does not offer. The shuffle files of
    the write go as soon as it ends, so they and those of the readers are not on disk together.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/visitloom-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    _stored.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_once(spark: SparkSession, name: str, make: Callable[[], DataFrame], codec: str = "snappy") -> DataFrame:
    """``store`` the result of ``make`` under a name; later calls of this application read it again."""
    key = spark.sparkContext.applicationId, name
    if key not in _named:
        _named[key] = store(make(), codec)
    return _named[key]


def release(spark: SparkSession) -> int:
    """Delete the intermediates this application has stored so far; returns how many.

    Call it when no DataFrame built on them is needed any more.
    """
    app = spark.sparkContext.applicationId
    paths = _stored.pop(app, [])
    for key in [k for k in _named if k[0] == app]:
        del _named[key]
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint a narrow or iterated table and continue from the checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
