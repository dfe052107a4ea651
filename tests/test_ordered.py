"""Ordered scans must give the same answer whether or not keys are split into blocks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitloom.functions import ordered as O

KINDS = dict(rn=("row_number", None), run=("running_sum", "v"), prior=("prior_sum", "v"), lag=("lag", "s"),
             lead=("lead", "s"), last=("last_known", "s"), nxt=("next_known", "s"))


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    # key 0 holds most rows, many share a time, some values are null, one key is null
    data = [(0 if rng.random() < 0.7 else rng.choice([1, 2, 3, None]), rng.randint(0, 20), i,
             rng.choice([None, 1, 2, 5]), rng.choice([None, None, "a", "b", "c"])) for i in range(600)]
    return spark.createDataFrame(data, "k int, ts int, id int, v int, s string").cache()


def answer(df, keys, order, descending=(), min_rows=None):
    laid, track = O.lay_track(df, keys, order, descending, min_rows=min_rows)
    out = O.lift_off(O.scan(laid, track, **KINDS))
    return track, sorted(map(tuple, out.select("id", *KINDS).collect()))


@pytest.mark.parametrize("keys,desc", [(["k"], []), ([], []), (["k"], ["ts"]), ([], ["ts"])])
def test_blocks_do_not_change_the_answer(rows, keys, desc):
    plain, want = answer(rows, keys, ["ts", "id"], desc)
    split, got = answer(rows, keys, ["ts", "id"], desc, min_rows=40)
    assert not plain.blocked and split.blocked and got == want


def test_a_hot_key_is_spread_over_blocks(rows):
    laid, track = O.lay_track(rows, ["k"], ["ts", "id"], min_rows=40)
    sizes = [r["count"] for r in laid.filter(F.col(O.BLOCK) > 0).groupBy("k", O.BLOCK).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 200
    assert laid.count() == 600


def test_chained_scans_reuse_the_layout(rows):
    def chain(min_rows):
        laid, track = O.lay_track(rows, ["k"], ["ts", "id"], min_rows=min_rows)
        a = O.scan(laid, track, prev=("lag", "ts"))
        b = O.scan(a.filter("prev is null or ts - prev > 0"), track, n=("row_number", None), nx=("lead", "id"))
        return sorted(map(tuple, b.select("id", "n", "nx").collect()), key=str)

    assert chain(None) == chain(40)


def plan_of(df):
    return df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("min_rows", [None, 40])
def test_no_frame_is_evaluated_anew_for_every_row(rows, min_rows):
    laid, track = O.lay_track(rows, ["k"], ["ts", "id"], min_rows=min_rows)
    plan = plan_of(O.scan(laid, track, **KINDS))
    assert "currentrow$(), unboundedfollowing$()" not in plan and "1, unboundedfollowing$()" not in plan


@pytest.mark.parametrize("min_rows", [None, 20])
@pytest.mark.parametrize("descending", [[], ["ts"], ["ts", "id"]])
def test_next_known_reads_the_order_from_the_end(spark, descending, min_rows):
    rng = random.Random(5)
    data = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(9)]), i, rng.choice([None, None, "a", "b"])) for i in range(200)]
    df = spark.createDataFrame(data, "k int, ts int, id int, s string")
    laid, track = O.lay_track(df, ["k"], ["ts", "id"], descending, min_rows=min_rows)
    got = {r["id"]: r["nx"] for r in O.scan(laid, track, nx=("next_known", "s")).collect()}
    sign = lambda c, v: -v if c in descending else v
    place = lambda r: (r[1] is None, sign("ts", r[1] or 0), sign("id", r[2]))
    want = {}
    for key in {r[0] for r in data}:
        known = None
        for r in sorted((r for r in data if r[0] == key), key=place, reverse=True):
            known = want[r[2]] = r[3] if r[3] is not None else known
    assert got == want


def test_spread(rows):
    agg = dict(m=F.max("s"), n=F.count(F.lit(1)))
    one = O.spread(rows, ["k"], **agg)
    two = O.spread(rows, ["k"], min_rows=40, **agg)
    key = lambda df: sorted(map(tuple, df.select("id", "m", "n").collect()))
    assert key(one) == key(two)


def test_quantiles_match_numpy(spark, rows):
    vals = [r["id"] ** 2 % 997 for r in rows.collect()]
    df = spark.createDataFrame([(v % 2, float(v)) for v in vals], "g int, x double")
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    for min_rows in (None, 30):
        for g, *q in O.quantiles(df, "x", probs, ["g"], min_rows).collect():
            assert np.allclose(q, np.quantile([v for v in vals if v % 2 == g], probs))
        assert np.allclose(O.quantiles(df, "x", probs, (), min_rows).drop("_all").first(), np.quantile(vals, probs))


def test_empty_input(spark):
    empty = spark.createDataFrame([], "k int, ts int, id int, v int, s string")
    laid, track = O.lay_track(empty, ["k"], ["ts", "id"])
    assert O.scan(laid, track, **KINDS).count() == 0
