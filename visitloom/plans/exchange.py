"""Queries that write a table below the checkpoint folder and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from visitloom.plans.registry import query
from visitloom.session import checkpoint_dir
from visitloom.sources import layout as L
from visitloom.sources import readers as R
from visitloom.sources import writers as O

ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string, price double"
ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CAST(o_totalprice AS DOUBLE) AS price FROM orders"


def _place(t) -> str:
    return f"{checkpoint_dir(t.spark)}/visitloom-io-{uuid.uuid4().hex}"


def _orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("double").alias("price"))


@query("s02_read_dump", ORDERS_SQL)
def s02(t):
    path = _place(t)
    O.unload(_orders(t), path)
    return R.read_dump(t.spark, path, ORDERS)


@query("s03_read_csv", ORDERS_SQL)
def s03(t):
    path = _place(t)
    O.unload(_orders(t), path, sep=",", header=True, compression="none")
    return R.read_dump(t.spark, path, ORDERS, sep=",", header=True)


@query("s04_parquet_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def s04(t):
    path = _place(t)
    O.convert(t.customer, path)
    return R.read_table(t.spark, path, ["c_custkey", "c_mktsegment"])


@query("s05_convert", ORDERS_SQL)
def s05(t):
    text, path = _place(t), _place(t)
    O.unload(_orders(t), text)
    O.convert(R.read_dump(t.spark, text, ORDERS), path, input_bytes=O.scan_bytes(t.spark.read.text(text)), target_bytes=1_000_000)
    return R.read_table(t.spark, path)


@query("s06_export_json", ORDERS_SQL)
def s06_json(t):
    path = _place(t)
    O.export_table(_orders(t), path, "json")
    return t.spark.read.schema(ORDERS).json(path)


@query("s06_export_csv", ORDERS_SQL)
def s06_csv(t):
    path = _place(t)
    O.export_table(_orders(t), path)
    return R.read_dump(t.spark, path, ORDERS, sep=",")


@query("s08_unload", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def s08(t):
    path, head = _place(t), _place(t)
    df = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    O.unload(df, path)
    O.write_header(df, head)
    names = t.spark.read.text(head).first()[0].split(";")
    return R.read_dump(t.spark, path, ", ".join(f"{n} {k}" for n, k in zip(names, ("bigint", "string", "string"))))


@query("s09_load_table", f"{ORDERS_SQL} UNION ALL {ORDERS_SQL}")
def s09(t):
    name = f"visitloom_{uuid.uuid4().hex}"
    O.load_table(_orders(t), name, path=_place(t))
    O.load_table(_orders(t), name, "append")
    return t.spark.table(name)


@query("s09_upsert_partitions", """SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE), '%Y-%m') AS month,
  CASE WHEN year(CAST(o_orderdate AS DATE)) = 1997 AND o_orderkey % 2 = 0 THEN 'CHANGED' ELSE o_orderpriority END AS o_orderpriority FROM orders
  WHERE o_orderkey % 3 <> 0 OR (year(CAST(o_orderdate AS DATE)) = 1997 AND o_orderkey % 2 = 0)""")
def s09_upsert(t):
    """A table by month; late and changed orders of one year come in and rewrite that year's months only."""
    path, day = _place(t), F.col("o_orderdate").cast("date")
    orders = t.orders.select("o_orderkey", F.date_format(day, "yyyy-MM").alias("month"), "o_orderpriority", F.year(day).alias("_y"))
    L.upsert_partitions(orders.filter("o_orderkey % 3 <> 0").drop("_y"), path, "month", ["o_orderkey"])
    late = orders.filter("_y = 1997 AND o_orderkey % 2 = 0").withColumn("o_orderpriority", F.lit("CHANGED")).drop("_y")
    L.upsert_partitions(late, path, "month", ["o_orderkey"])
    return t.spark.read.schema("o_orderkey bigint, o_orderpriority string, month string").parquet(path)


@query("s04_bucketed_join", """SELECT c_custkey, any_value(c_mktsegment) AS c_mktsegment, count(o_orderkey) AS n, round(sum(CAST(o_totalprice AS DOUBLE)), 2) AS total
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def s04_bucketed(t):
    """Join and aggregation of two tables bucketed by the customer, without an exchange."""
    customers = L.save_bucketed(t.customer.select("c_custkey", "c_mktsegment"), f"visitloom_{uuid.uuid4().hex}", ["c_custkey"], 8, path=_place(t))
    orders = L.save_bucketed(_orders(t), f"visitloom_{uuid.uuid4().hex}", ["o_custkey"], 8, path=_place(t))
    both = customers.hint("merge").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return both.groupBy("c_custkey").agg(F.first("c_mktsegment").alias("c_mktsegment"), F.count("o_orderkey").alias("n"), F.round(F.sum("price"), 2).alias("total"))


@query("s10_query_to_table", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def s10(t):
    name, view = f"visitloom_{uuid.uuid4().hex}", f"visitloom_{uuid.uuid4().hex}"
    t.orders.createOrReplaceTempView(view)
    O.query_to_table(t.spark, f"SELECT o_orderstatus, count(*) AS n FROM {view} GROUP BY 1", name, overwrite=False, path=_place(t))
    return t.spark.table(name)


@query("s12_check_scan", "SELECT count(*) AS n FROM orders")
def s12(t):
    return O.check_scan(t.orders, 1 << 60).agg(F.count(F.lit(1)).alias("n"))


@query("s12_column_scan", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def s12_columns(t):
    """Passes a limit that one column stays below and the whole table exceeds."""
    whole = L.column_bytes(t.lineitem)
    df = L.check_column_scan(t.lineitem.select("l_returnflag"), whole // 2)
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("s13_retention", "SELECT o_orderkey, o_custkey FROM orders WHERE strftime(CAST(o_orderdate AS DATE), '%Y-%m') >= '1997-03'")
def s13(t):
    """A table by month of which the partitions before a month are dropped."""
    name = f"visitloom_{uuid.uuid4().hex}"
    month = F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM")
    O.load_table(t.orders.select("o_orderkey", "o_custkey", month.alias("dt")).repartition("dt"), name, path=_place(t), partition_by=["dt"])
    O.drop_partitions_before(t.spark, name, "dt", "1997-03")
    return t.spark.table(name).select("o_orderkey", "o_custkey")


@query("s14_payload", ORDERS_SQL)
def s14(t):
    path = _place(t)
    O.export_table(_orders(t), path, "json")
    return R.read_payload(t.spark, path, ORDERS)


@query("s15_study_files", "SELECT c_name, CAST(c_custkey AS VARCHAR) AS c_custkey, true AS is_flagged FROM customer")
def s15(t):
    path = f"{_place(t)}/lift_study.xml"
    cells = F.array(*[F.struct(F.col(c).cast("string").alias("Data")) for c in ("c_name", "c_custkey")])
    t.customer.select(cells.alias("Cell")).write.option("rowTag", "Row").option("rootTag", "Table").xml(path)
    return R.read_study(t.spark, path, ["c_name", "c_custkey"], "part-")


@query("s18_artifacts", "SELECT '90' AS model_id, CAST(count(*) AS DOUBLE) AS n FROM orders")
def s18(t):
    folder = _place(t)
    O.save_artifacts(None, {"n": t.orders.count()}, {"orders": t.orders}, folder, "90", t.spark)
    saved = t.spark.read.json(f"{folder}/90/metrics").select("model_id", F.col("metrics.n").alias("n"))
    return saved.filter(F.col("n") == F.lit(t.spark.read.parquet(f"{folder}/90/orders").count()))
