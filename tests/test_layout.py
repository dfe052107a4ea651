"""Scan sizes by column, partition upserts, bucketed tables, daily sketches, chains run to absorption."""

import glob
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from visitloom.operators import markov as M
from visitloom.operators import rollups as R
from visitloom.sources import layout as L

LINES = "/root/testdata/sf0.01/lineitem.parquet"


def by_hand(folder, columns, groups=lambda g: True):
    total = 0
    for path in glob.glob(f"{folder}/*.parquet") or [folder]:
        meta = pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            row_group = meta.row_group(g)
            chunks = [row_group.column(i) for i in range(row_group.num_columns)]
            if groups(row_group):
                total += sum(c.total_compressed_size for c in chunks if not columns or c.path_in_schema in columns)
    return total


def test_column_bytes_equal_the_footers(spark):
    df = spark.read.parquet(LINES)
    one = L.column_bytes(df.select("l_returnflag"))
    assert one == by_hand(LINES, {"l_returnflag"}) and L.column_bytes(df) == by_hand(LINES, None) > 5 * one
    both = L.column_bytes(df.filter("l_quantity > 3").groupBy("l_returnflag").count())
    assert both == by_hand(LINES, {"l_returnflag", "l_quantity"})
    with pytest.raises(ValueError, match="would read"):
        L.check_column_scan(df, one)
    assert L.column_bytes(spark.range(3)) == 0


def test_row_groups_and_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 400_000, numPartitions=4).select("id", (F.col("id") % 2).alias("part"), F.md5(F.col("id").cast("string")).alias("v")).write.partitionBy("part").option("parquet.block.size", 65536).parquet(path)
    df = spark.read.parquet(path)
    half = L.column_bytes(df.filter("part = 1").select("v"))
    assert half == by_hand(f"{path}/part=1", {"v"})
    few = L.column_bytes(df.filter("part = 1 AND id < 150000").select("v"))
    low = lambda g: g.column(0).statistics.min < 150000
    assert few == by_hand(f"{path}/part=1", {"id", "v"}, low) < by_hand(f"{path}/part=1", {"id", "v"})


def test_upsert_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "queue")
    schema = "item int, status string, day string"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert L.upsert_partitions(rows((1, "new", "d1"), (2, "new", "d1"), (3, "new", "d2"), (4, "new", None)), path, "day", ["item"]) == 3
    files = lambda d: sorted(os.listdir(f"{path}/day={d}"))
    before = files("d2")
    assert L.upsert_partitions(rows((2, "done", "d1"), (5, "new", "d3")), path, "day", ["item"]) == 2
    table = lambda: sorted(map(tuple, spark.read.schema(schema).parquet(path).collect()))
    now = [(1, "new", "d1"), (2, "done", "d1"), (3, "new", "d2"), (4, "new", None), (5, "new", "d3")]
    assert table() == now and files("d2") == before
    with pytest.raises(ValueError, match="twice"):
        L.upsert_partitions(rows((1, "a", "d1"), (1, "b", "d1")), path, "day", ["item"])
    with pytest.raises(ValueError, match="another partition"):
        L.upsert_partitions(rows((3, "done", "d1")), path, "day", ["item"])
    assert table() == now
    L.upsert_partitions(rows((1, "a", "d1"), (1, "b", "d1")), path, "day", ["item"], order=F.col("status"))
    assert (1, "b", "d1") in table() and len(table()) == 5


def test_bucketed_tables_need_no_exchange(spark, tmp_path):
    tables = []
    for name in ("left_b", "right_b"):
        df = spark.range(5000).select((F.col("id") % 700).alias("k"), F.col("id").alias(name))
        tables.append(L.save_bucketed(df, f"layout_{name}", ["k"], 8, path=str(tmp_path / name)))
    joined = tables[0].hint("merge").join(tables[1], "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    again = joined.hint("merge").join(tables[0].groupBy("k").agg(F.max("left_b").alias("m")), "k")
    for df in (joined, again):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert again.count() == 700 and joined.agg(F.sum("n")).first()[0] == sum((5000 // 700 + (k < 5000 % 700)) ** 2 for k in range(700))


def test_sketches_roll_up_within_their_bounds(spark):
    df = spark.range(120_000).select((F.col("id") % 10).alias("day"), (F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 40_000).alias("user"), (F.col("id") % 1000).cast("double").alias("v"))
    days = F.col("day").between(2, 6)
    got = {r.g: r for r in R.roll_up(R.daily_sketches(df, "day", ["g"], "user", "v"), ["g"], days, (0.5, 0.9)).collect()}
    for r in R.exact(df.filter(days), ["g"], "user").collect():
        values = np.sort([x.v for x in df.filter(days & (F.col("g") == r.g)).collect()])
        assert got[r.g].n == r.n_exact and abs(got[r.g].n_distinct / r.distinct_exact - 1) <= R.distinct_error()
        for q, p in (("q0", 0.5), ("q1", 0.9)):
            rank = np.searchsorted(values, got[r.g][q], "right") / len(values)
            assert abs(rank - p) < 0.02


def test_chains_run_to_absorption(spark):
    rng = np.random.default_rng(6)
    names = ["a", "b", "c", "d"]
    rows = [(f, t, int(rng.integers(1, 60))) for f in names for t in [*names, "END", "CONVERSION"]] + [("START", n, 5) for n in names]
    rows = [r for r in rows if r[:2] != ("d", "CONVERSION")] + [("stuck", "stuck", 3), ("START", "stuck", 1)]
    p = {}
    for f, t, n in rows:
        p.setdefault(f, {})[t] = n
    p = {f: {t: n / sum(ts.values()) for t, n in ts.items()} for f, ts in p.items()}
    q = np.array([[p[f].get(t, 0) for t in names] for f in names])
    want = np.linalg.solve(np.eye(4) - q, [p[f].get("CONVERSION", 0) for f in names])
    edges = spark.createDataFrame(rows, "from_state string, to_state string, cnt long")
    chain = M.transition_probs(edges).filter(~F.col("from_state").isin(*M.TERMINAL) & (F.col("to_state") != M.END))
    got = {r.channel: r.reach for r in M._reach_conversion(chain, [], 1e-13, 100_000).collect()}
    assert np.allclose([got[n] for n in names], want) and "stuck" not in got and got["START"] == pytest.approx(want.mean() * 20 / 21)
