import gzip

import pytest
from pyspark.sql import functions as F

from visitloom.sources import readers as R
from visitloom.sources import schemas as Z
from visitloom.sources import writers as O
from visitloom import session


@pytest.fixture()
def small(spark):
    return spark.createDataFrame([(1, "a;b", 1.5), (2, 'q"x', None)], "id int, s string, v double")


def test_gzip_dump(spark, tmp_path):
    with gzip.open(tmp_path / "d.csv.gz", "wt") as f:
        f.write('1;"x;y";2.5\n2;;bad\n')
    df = R.read_dump(spark, str(tmp_path), "id int, s string, v double")
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "x;y", 2.5), (2, None, None)]


def test_unload_header_and_round_trip(spark, small, tmp_path):
    p = str(tmp_path / "u")
    O.unload(small, p)
    back = R.read_dump(spark, p, "id int, s string, v double").orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, "a;b", 1.5), (2, 'q"x', None)]
    O.write_header(small, str(tmp_path / "h"))
    assert spark.read.text(str(tmp_path / "h")).first()[0] == "id;s;v"


def test_exports(spark, small, tmp_path):
    O.export_table(small, str(tmp_path / "c"))
    O.export_table(small, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and spark.read.csv(str(tmp_path / "c")).count() == 2


def test_convert_and_columns(spark, small, tmp_path):
    O.convert(small, str(tmp_path / "p"), input_bytes=250_000_000)
    assert R.read_table(spark, str(tmp_path / "p"), ["id"]).columns == ["id"]


def test_tables(spark, small):
    O.drop_if_exists(spark, "t_io")
    O.load_table(small, "t_io")
    O.load_table(small, "t_io", "append")
    assert spark.table("t_io").count() == 4
    with pytest.raises(Exception):
        O.load_table(small, "t_io")
    with pytest.raises(ValueError):
        O.query_to_table(spark, "SELECT 1 AS x", "t_io", overwrite=False)
    O.query_to_table(spark, "SELECT 1 AS x", "t_io")
    O.set_expiry(spark, "t_io", "2020-01-01")
    assert O.sweep_expired(spark, ["t_io"], "2020-01-01") == []
    O.set_expiry(spark, "t_io", None)
    assert O.sweep_expired(spark, ["t_io"], "2030-01-01") == []
    O.set_expiry(spark, "t_io", "2020-01-01")
    assert O.sweep_expired(spark, ["t_io"], "2020-01-02") == ["t_io"] and not spark.catalog.tableExists("t_io")


def test_scan_guard(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert O.check_scan(df, 10 ** 9) is df
    with pytest.raises(ValueError):
        O.check_scan(df, 10)


@pytest.mark.parametrize("n,want", [(0, (0, "")), (1023, (1023, "")), (1024, (1, "k")), (5 * 1024 ** 3, (5, "G"))])
def test_readable_size(n, want):
    assert O.readable_size(n) == want


def test_study_files(spark, tmp_path):
    row = lambda *v: "<Row>" + "".join(f"<Cell><Data>{x}</Data></Cell>" for x in v) + "</Row>"
    for name, val in (("lift_brandx.xml", "#NULL!"), ("other.xml", "4")):
        (tmp_path / name).write_text("<Workbook><Table>" + row("study_id", "buyers") + row("s1", val) + "</Table></Workbook>")
    got = R.read_study(spark, str(tmp_path), ["study_id", "buyers"], "brandx").orderBy("buyers").collect()
    assert [tuple(r) for r in got] == [("s1", "#NULL!", True), ("s1", "4", False)]


def test_payload(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"id": 1, "v": 2.5}\n')
    assert tuple(R.read_payload(spark, str(tmp_path / "p.json"), "id int, v double").first()) == (1, 2.5)


def test_ranges(spark):
    df = spark.createDataFrame([("20200101",), ("20200105",), ("intraday_20200105",), ("20210101",)], "dt string")
    assert R.scan_sessions(df, [20200105]).count() == 2
    assert R.scan_sessions(df, [[20200105, 0]]).count() == 3
    assert R.scan_sessions(df, []).count() == 0
    with pytest.raises(ValueError):
        R.scan_sessions(df, [[1, 2, 3]])


def test_partition_pruning(spark, tmp_path):
    spark.createDataFrame([(1, "20200101"), (2, "20200102")], "id int, dt string").write.partitionBy("dt").parquet(str(tmp_path / "s"))
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    df = R.scan_sessions(spark.read.parquet(str(tmp_path / "s")), [20200102])
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "true")
    assert df.count() == 1 and len(df.inputFiles()) >= 1
    assert "PartitionFilters: [" in df._jdf.queryExecution().toString() and "PartitionFilters: []" not in df._jdf.queryExecution().toString()


def test_artifacts(spark, small, tmp_path):
    from visitloom.operators.ml import models as M
    df = small.na.fill(0.0).withColumn("label", (F.col("id") % 2).cast("double"))
    model = M.fit("logistic", df, M.feature_stages(["v"]))
    O.save_artifacts(model, {"auc": 0.5}, {"t": small}, str(tmp_path), "90", spark)
    assert spark.read.parquet(str(tmp_path / "90" / "t")).count() == 2
    assert spark.read.json(str(tmp_path / "90" / "metrics")).first()["metrics"]["auc"] == 0.5


def test_urls(spark):
    df = spark.createDataFrame([("http://a/b",), ("//h/x",), ("/h/x",), ("h//x",), ("h/x/",)], "u string")
    got = [r[0] for r in df.select(O.image_url("u")).collect()]
    assert got == ["http://a/b", "http:///h/x", "http://h/x", "http://h/x", "http://h/x"]


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"), 1)], "a double, b int")
    assert Z.nan_to_null(df).first()["a"] is None


def test_checkpoint_folder_comes_from_the_session(spark):
    assert spark.conf.get("spark.checkpoint.dir") in session.checkpoint_dir(spark)


def test_old_partitions_go(spark, tmp_path):
    df = spark.createDataFrame([(1, "2020-01-01"), (2, "2020-01-02"), (3, "2020-01-03")], "id int, dt string")
    O.drop_if_exists(spark, "t_dated")
    O.load_table(df, "t_dated", path=str(tmp_path / "dated"), partition_by=["dt"])
    assert O.drop_partitions_before(spark, "t_dated", "dt", "2020-01-03") == ["2020-01-01", "2020-01-02"]
    assert [r["id"] for r in spark.table("t_dated").collect()] == [3]
    O.drop_if_exists(spark, "t_dated")


def test_stored_intermediates_can_be_released(spark):
    import glob
    df = session.store(spark.range(5))
    folder = df.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    once = session.store_once(spark, "five", lambda: spark.range(5))
    assert session.store_once(spark, "five", lambda: spark.range(9)) is once and glob.glob(f"{folder}/part-*")
    assert session.release(spark) >= 2 and not glob.glob(f"{folder}/part-*")
    assert session.store_once(spark, "five", lambda: spark.range(9)).count() == 9


def test_store_leaves_no_shuffle_files(spark):
    import time
    def shuffles():
        files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        names = (f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files))
        return {n for n in names if n.startswith("shuffle_")}
    setting, before = spark.conf.get(session.SHUFFLE_CLEANUP, None), shuffles()
    df = session.store(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before and df.count() == 7
    assert spark.conf.get(session.SHUFFLE_CLEANUP, None) == setting
