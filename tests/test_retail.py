import datetime as dt

import pytest
from pyspark.sql import functions as F

from visitloom.functions import columns as X
from visitloom.operators import catalog as K
from visitloom.operators import customers as C

# Known dates, independent of the rule.
BLACK_FRIDAYS = """2011-11-25 2012-11-23 2013-11-29 2014-11-28 2015-11-27 2016-11-25 2017-11-24 2018-11-23 2019-11-29
2020-11-27 2021-11-26 2022-11-25 2023-11-24 2024-11-29 2025-11-28 2026-11-27 2027-11-26 2028-11-24 2029-11-23 2030-11-29""".split()


def test_black_friday_calendar(spark):
    got = spark.range(2011, 2031).select(X.black_friday("id").cast("string")).collect()
    assert [r[0] for r in got] == BLACK_FRIDAYS


@pytest.mark.parametrize("day,want", [("2019-11-29", 371), ("2019-11-30", 1), ("2019-01-01", 39)])
def test_days_since_black_friday(spark, day, want):
    df = spark.createDataFrame([(day,)], "d string").select(F.to_date("d").alias("d"))
    assert df.select(X.days_since_black_friday("d")).first()[0] == want


def test_dialect_traps(spark):
    df = spark.createDataFrame([("2000-12-31", "2001-01-01", 12.5)], "a string, b string, p double")
    r = df.select(X.year_gap(F.to_date("a"), F.to_date("b")).alias("y"), X.snap_price("p").alias("s"),
                  X.extract_valid(F.lit("zz"), "^[0-9]+$").alias("e")).first()
    assert (r["y"], round(r["s"], 2), r["e"]) == (1, 9.99, None)


def test_slug_state(spark):
    df = spark.createDataFrame([("b'São Paulo'",)], "s string")
    assert df.select(X.slug_state("s")).first()[0] == "Sao_Paulo"


ORD = "fk_customer int, sale_order_store_number int, sale_order_store_date string, gmv decimal(18,2)"


def churn(spark, rows, **kw):
    from decimal import Decimal
    df = spark.createDataFrame([(*r[:3], Decimal(r[3])) for r in rows], ORD).withColumn("sale_order_store_date", F.to_date("sale_order_store_date"))
    return {r["sale_order_store_number"]: r for r in C.churn_episodes(df, "2021-01-01", **kw).collect()}


def test_one_order_customer(spark):
    got = churn(spark, [(1, 10, "2019-01-01", 5)])
    assert got[10]["is_last_order"] and got[10]["episode"] == 1 and got[10]["orders_12m"] == 1
    assert churn(spark, [(1, 10, "2020-12-01", 5)]) == {}


def test_gap_of_exactly_a_year_ends_the_episode(spark):
    rows = [(1, 1, "2018-01-01", 5), (1, 2, "2019-01-01", 6), (1, 3, "2019-12-31", 7)]
    got = churn(spark, rows)
    assert got[1]["is_last_order"] and got[2]["is_reactivation_sale"] and got[2]["episode"] == 2
    # 364 days: the episode goes on; the third order is its last, but not a year before today
    assert not got[2]["is_last_order"] and got[2]["orders_12m"] == 2
    assert 3 in got and got[3]["is_last_order"]


def test_twelve_month_totals_and_hot_customers(spark):
    rows = [(1, i, str(dt.date(2015, 1, 1) + dt.timedelta(days=60 * i)), i) for i in range(20)]
    rows += [(2, 100 + i, str(dt.date(2016, 1, 1) + dt.timedelta(days=400 * i)), 3) for i in range(4)]
    a, b = churn(spark, rows), churn(spark, rows, min_rows=3)
    assert {k: tuple(v) for k, v in a.items()} == {k: tuple(v) for k, v in b.items()}
    last = a[19]
    assert last["lifetime_orders"] == 20 and last["orders_12m"] == 7 and float(last["revenue_12m"]) == sum(range(13, 20))


def test_second_row_or_second_order(spark):
    base = dict(is_paid=1, channel="c", brand_partner="p", device="d", birth_year=1980, gender="f", state="SP", is_market_place=1,
                is_crossdocking=0, is_private_label=0, is_brand=0, gmv=1.0)
    day = lambda s: dt.date.fromisoformat(s)
    rows = [dict(base, fk_customer=1, sale_order_store_number=7, sale_date=day("2020-01-01"), expected_delivery_date=day("2020-01-05"), delivered_date=day(d)) for d in ("2020-01-04", "2020-01-06")]
    rows.append(dict(base, fk_customer=1, sale_order_store_number=8, sale_date=day("2020-03-01"), expected_delivery_date=day("2020-03-05"), delivered_date=day("2020-03-04")))
    df = spark.createDataFrame(rows)
    assert C.first_order_features(df, "2019-01-01", "2021-01-01").first()["second_sale_date"] == "20200101"
    f = C.first_order_features(df, "2019-01-01", "2021-01-01", by_order=True)
    assert f.first()["second_sale_date"] == "20200301"
    lab = C.second_order_labels(f, "2021-01-01").first()
    assert lab["waiting_time"] == 60 and (lab["label_30"], lab["label_90"]) == (0, 1)
    missing = C.second_order_labels(f.withColumn("second_sale_date", F.lit(None).cast("string")), "2021-01-01").first()
    assert not missing["has_second_purchase"] and missing["waiting_time"] == 731


def test_pareto_drops_values_never_counted(spark):
    df = spark.createDataFrame([("a", 1)] * 9 + [("b", 1)] * 1 + [("z", None)], "p string, s int")
    got = sorted(r["p_new"] for r in C.pareto_bucket(df, "p", counted=F.col("s").isNotNull()).collect())
    # a reaches exactly 90 percent, which is no longer below the limit
    assert got == ["OTHER"] * 10


def test_cut_edges(spark):
    df = spark.createDataFrame([(0,), (30,), (31,), (366,)], "w int")
    got = [r[0] for r in df.select(X.cut("w", C.PERIODS, C.PERIOD_LABELS, include_lowest=True)).collect()]
    assert got == ["first_month", "first_month", "first_quarter", None]


def test_split_is_exact_and_hot_label_safe(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    out = K.stratified_split(df, "y", {"train": 0.7, "valid": 0.1, "test": 0.2}, "id")
    got = {(r["y"], r["part"]): r["count"] for r in out.groupBy("y", "part").count().collect()}
    assert got == {(0, "train"): 630, (0, "valid"): 90, (0, "test"): 180, (1, "train"): 70, (1, "valid"): 10, (1, "test"): 20}


def test_clean_text(spark):
    df = spark.createDataFrame([("<b>Big</b> DOG, the  dog's!",), (None,)], "t string")
    assert [r["t"] for r in K.clean_text(df, "t", ["the"]).collect()] == ["big dog dogs", ""]


def test_assert_unique(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        K.assert_unique(df, ["k"])


def test_perturb_rates(spark):
    df = spark.range(20000).select("id", F.lit(1.0).alias("price"), F.lit(1.0).alias("box_width"))
    out = K.perturb(df, 5, "id", missing={"box_width": 0.12}).agg(F.avg((F.col("price") > 1).cast("int")), F.avg(F.col("box_width").isNull().cast("int"))).first()
    assert abs(out[0] - 0.05) < 0.01 and abs(out[1] - 0.12) < 0.01


def test_first_order_keeps_unpaid_items_and_skips_customers_of_old(spark):
    day = lambda s: dt.date.fromisoformat(s)
    base = dict(brand_partner="p", device="d", birth_year=1980, gender="f", state="SP", is_crossdocking=0, is_private_label=0, is_brand=0,
                expected_delivery_date=day("2020-01-05"), delivered_date=day("2020-01-04"))
    item = lambda who, number, date, paid, channel, market, gmv: dict(
        base, fk_customer=who, sale_order_store_number=number, sale_date=day(date), is_paid=paid, channel=channel, is_market_place=market, gmv=gmv)
    df = spark.createDataFrame([
        item(1, 5, "2019-12-01", 0, "a", 1, 9.0),                                                # never paid: not the first order
        item(1, 7, "2020-01-01", 1, "m", 0, 1.0), item(1, 7, "2020-01-01", 1, "m", 0, 2.0),      # equal rows are one
        item(1, 7, "2020-01-01", 0, "b", 1, 4.0),
        item(1, 8, "2020-01-01", 1, "z", 0, 8.0),                                                # same day, next order
        item(2, 1, "2018-01-01", 1, "m", 0, 1.0), item(2, 2, "2020-01-01", 1, "m", 0, 1.0)])
    for by_order in (False, True):
        (r,) = C.first_order_features(df, "2019-01-01", "2021-01-01", by_order).collect()
        assert (r["fk_customer"], r["first_sale_number"], r["first_sale_date"], r["second_sale_date"]) == (1, 7, "20200101", "20200101")
        assert (r["channel"], r["has_marketplace"], r["gmv"], r["age"]) == ("m", 1, 7.0, 41)
    assert C.first_order_features(df.filter("false"), "2019-01-01", "2021-01-01").count() == 0


def test_profile_keeps_types_and_counts_blanks(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (9, "b"), (10, None), (None, "a"), (100, "c")], "n int, t string")
    got = {r["column"]: r for r in K.profile_columns(df, ["n"], ["t"], few=3).collect()}
    n, t = got["n"], got["t"]
    assert (n["rows"], n["non_null"], n["n_distinct"], n["top_value"], n["min"], n["q25"], n["q50"], n["max"]) == (6, 5, 3, "10", 9, 9, 10, 100)
    assert (t["rows"], t["non_null"], t["n_distinct"], t["top_value"], t["mean"], t["q50"]) == (6, 5, 3, "a", None, None)
    assert n["few_values"] and n["mean"] == 27.6
    (only,) = K.profile_columns(df.filter("t = 'none'"), [], ["t"]).collect()
    assert (only["rows"], only["n_distinct"], only["top_value"], only["q25"]) == (0, 0, None, None)


def test_share_by_year_keeps_dates_after_the_last_range(spark):
    from visitloom.operators import timeseries as S

    rows = [(dt.date(y, 11, 27), 10, 5.0, 5.0) for y in (2019, 2020, 2026)] + [(dt.date(2020, 6, 1), 1, 1.0, 1.0), (dt.date(2026, 6, 1), 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "sale_date date, sale_hour int, gtv_after double, gtv_before double")
    got = {(r["y"], r["n_gtv"]) for r in S.hourly_share_by_year(df, 2020, last_year=2021).collect()}
    assert got == {(2020, 1.0), (2026, 1.0)}
