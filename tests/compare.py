"""Run registered queries on Spark and their oracle SQL on DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for n in TABLES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{folder}/{n}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        v = round(v, 6)
        return int(v) if v == int(v) else v
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark_df, con, sql):
    cols, got = rows_of(spark_df.columns, spark_df.collect())
    cur = con.execute(sql)
    ocols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != ocols:
        return f"columns differ: {cols} vs {ocols}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first: {bad[0]}" if bad else None


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1]
    names = sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, runs, sqls = duck(folder), entry.queries(), entry.oracle_sql()
    picked = [n for n in runs if not names or any(n.startswith(p) for p in names)]
    failed = 0
    for n in picked:
        t0 = time.time()
        try:
            df = runs[n](spark, folder)
            if n in sqls:
                msg = compare(df, con, sqls[n])
                tag = "ok " if msg is None else "BAD"
            else:
                k = df.count()
                msg, tag = f"{k} rows", "run" if k else "BAD"
        except Exception as e:
            msg, tag = str(e)[:700], "ERR"
        failed += tag in ("BAD", "ERR")
        print(f"{tag} {n} {time.time() - t0:.1f}s {msg or ''}", flush=True)
    print(f"{len(picked)} queries, {failed} failed")
