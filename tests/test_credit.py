import math

import pytest
from pyspark.sql import functions as F

from visitloom.operators import attribution as A
from visitloom.operators import costs as C
from visitloom.operators import markov as M
from visitloom.plans import RUN
from visitloom.plans import inputs as N
from visitloom import session


@pytest.fixture(scope="module")
def chain(spark):
    # START -> a (1); a -> b 1/2, CONV 1/4, END 1/4; b -> a 1/4, CONV 1/4, END 1/2
    rows = [("START", "a", 8), ("a", "b", 4), ("a", "CONVERSION", 2), ("a", "END", 2), ("b", "a", 1), ("b", "CONVERSION", 1), ("b", "END", 2)]
    return spark.createDataFrame(rows, "from_state string, to_state string, cnt long")


def table(df):
    return {r["channel"]: r["weight"] for r in df.collect()}


def test_probabilities_sum_to_one(chain):
    sums = M.transition_probs(chain).groupBy("from_state").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in sums)


def test_eventual_conversion_closed_form(chain):
    # a = 1/4 + b/2, b = 1/4 + a/4  ->  a = 3/7, b = 5/14
    got = table(M.eventual_conversion(chain, digits=9))
    assert abs(got["a"] - 6 / 11) < 1e-6 and abs(got["b"] - 5 / 11) < 1e-6


def test_absorbing_removal_closed_form(chain):
    # without a: b converts 1/4, START never; without b: a and START convert 1/4 each
    got = table(M.removal_effect(chain, "absorbing"))
    assert abs(got["a"] - 0.25 / 0.75) < 1e-9 and abs(got["b"] - 0.5 / 0.75) < 1e-9


def test_drop_removal(chain):
    base = 3 / 7
    got = table(M.removal_effect(chain, "drop", digits=9))
    assert abs(got["a"] - ((0.25 / 0.75) / base - 1)) < 1e-8
    assert abs(got["START"] - ((0.5 / 1.25) / base - 1)) < 1e-8


def test_redirect_removal_is_normalised(chain):
    got = table(M.removal_effect(M.prune_channels(chain, 0), "redirect", digits=9))
    assert abs(sum(got.values()) - 1) < 1e-6


def test_ppr_excludes_terminals_and_sums_to_one(chain):
    got = table(M.ppr_contribution(chain, digits=9))
    assert set(got) == {"a", "b"} and abs(sum(got.values()) - 1) < 1e-6


def test_powers_are_matrix_powers(chain):
    import numpy as np
    names = ["START", "a", "b", "END", "CONVERSION"]
    m = np.zeros((5, 5))
    for r in M.transition_probs(M.prune_channels(chain, 0)).collect():
        m[names.index(r["to_state"]), names.index(r["from_state"])] = r["p"]
    keep = [0, 2, 3, 4]
    p3 = np.linalg.matrix_power(m[np.ix_(keep, keep)], 3)
    rate = p3[3, :2].sum() / (p3[3, :2].sum() + p3[2, :2].sum())
    got = table(M.removal_effect(M.prune_channels(chain, 0), "drop", n=2, digits=9))
    assert abs(got["a"] - (rate / (3 / 7) - 1)) < 1e-8


def test_pruning_keeps_a_channel_at_the_threshold(spark):
    e = spark.createDataFrame([("a", "b", 90), ("b", "a", 9), ("c", "a", 1), ("a", "c", 0)], "from_state string, to_state string, cnt long")
    states = {r["from_state"] for r in M.prune_channels(e, 1.0, refill=False).collect()}
    assert states == {"a", "b", "c"}
    states = {r["from_state"] for r in M.prune_channels(e, 1.1, refill=False).collect()}
    assert states == {"a", "b"}


def touches(spark):
    rows = [("g", 0, 1, 3, 1, "x", "t1"), ("g", 0, 2, 3, 1, "y", "t1"), ("g", 0, 3, 3, 1, "x", "t2"),
            ("h", 0, 1, 1, 1, "y", "t1"), ("i", 0, 1, 2, 1, "x", "t2"), ("i", 0, 2, 2, 1, "z", "t1"), ("j", 0, 1, 1, 0, "q", "t1")]
    return spark.createDataFrame(rows, "gid string, conv_group int, pos int, n_touches int, cv_marker int, utm_hash string, trin string")


def by(df, value):
    return {r["medium"]: r[value] for r in df.collect()}


def test_position_rules(spark):
    t = touches(spark)
    assert by(A.first_touch(t), "first_touch") == pytest.approx({"x": 2 / 3, "y": 1 / 3, "z": 0, "q": 0})
    assert by(A.last_touch(t), "last_touch") == pytest.approx({"x": 1 / 3, "y": 1 / 3, "z": 1 / 3, "q": 0})
    want = {"x": (0.8 + 0.5) / 3, "y": (0.2 + 1) / 3, "z": 0.5 / 3, "q": 0}
    assert by(A.position_based(t), "position_based") == pytest.approx(want)


def test_no_converting_path_gives_null_not_failure(spark):
    none = touches(spark).withColumn("cv_marker", F.lit(0))
    assert set(by(A.first_touch(none), "first_touch").values()) == {None}


def test_weights_sum_to_one_per_path_and_medium(spark):
    t = touches(spark).withColumns({"path_end": F.lit(86400 * 3), "sess": F.col("pos") * 86400})
    w = A.time_decay_weights(t, 0.5)
    assert sum(by(A.weighted_attribution(w), "norm_att").values()) == pytest.approx(1)
    per = A.position_profile(w).groupBy("medium").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in per)


def test_rollup_counts_a_utm_under_each_of_its_trinomials(spark):
    t = touches(spark)
    m = A.utm_map(t)
    out = {r["trinomial"]: r["first_touch"] for r in A.rollup(A.first_touch(t), m, "first_touch").collect()}
    assert out["t2"] == pytest.approx(2 / 3) and out["t1"] == pytest.approx(1)


# ------------------------------------------------------------------ costs and lift
COST = "id_cost string, cost_date string, cost_allocation int, store_id int, device_id int, currency_id int, country_id int, legal_entity_name string, gl_account_id int, category_name string, supplier_name string, account_name string, channel_name string, short_description string, value decimal(18,2)"


def test_month_spread_and_missing_rate(spark):
    rows = [("m", "2020-02-10", 30, 1, 3, 1, 9, "e", 6, "Canais X", "s", None, "c", None, 58), ("d", "2020-01-31", 1, 99, 99, 1, None, None, None, None, "s", "a", "c", "x", 7),
            ("o", "2021-12-31", 7, 3, 3, 1, 5, "e", 1, "Other", "s", None, "c", None, 31)]
    from decimal import Decimal
    costs = spark.createDataFrame([(*r[:-1], Decimal(r[-1])) for r in rows], COST).withColumn("cost_date", F.to_date("cost_date"))
    fx = spark.createDataFrame([(173, "2020-02-10", 1, 2.0)], "fx_currency int, fx_date string, fx_company int, rate double").withColumn("fx_date", F.to_date("fx_date"))
    out = C.allocate_costs(costs, fx)
    agg = {r["id_cost"]: r for r in out.groupBy("id_cost").agg(F.count("*").alias("n"), F.sum("original_value").alias("o"), F.sum("exchanged_value").alias("e"), F.min("id_store").alias("st"), F.max("id_date").alias("last")).collect()}
    assert (agg["m"]["n"], round(agg["m"]["o"], 6), round(agg["m"]["e"], 6)) == (29, 58, 116)
    assert (agg["d"]["n"], agg["d"]["e"], agg["d"]["st"]) == (1, 7.0, 0)
    ledger = {r["id_cost"]: (r["id_country"], r["id_company"], r["is_tool"], r["category_name"]) for r in out.collect()}
    assert ledger == {"m": (0, 1, 1, "PERFORMANCE"), "d": (0, 1, 0, None), "o": (5, 2, 0, "Other")}
    assert agg["o"]["n"] == 31 and str(agg["o"]["last"]) == "2021-12-31"


FOLDER = "/root/testdata/sf0.001"


def test_cost_by_utm_stores_no_row_per_day(spark):
    t = N.Tables(spark, FOLDER)
    app, most = spark.sparkContext.applicationId, t.lineitem.count()
    before = set(session._stored.get(app, []))
    rows = RUN["d38_cost_by_utm"](t).count()
    stored = [spark.read.parquet(p) for p in set(session._stored[app]) - before]
    assert rows and not [d.columns for d in stored if {"id_date", "exchanged_value"} & set(d.columns)]
    assert max(d.count() for d in stored if "fx_date" not in d.columns) <= most


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_repeated_costs_count_once(spark, monkeypatch, most):
    monkeypatch.setattr(C, "MAX_REPEATS", most)
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), ("c", 3), (None, 4), (None, 4)], "id string, v int")
    out = C.drop_repeats(df, "id")
    assert out.columns == ["id", "v"] and sorted(r["v"] for r in out.collect()) == [1, 2, 3, 4]
    once = df.filter("id IN ('a', 'c')")
    assert C.drop_repeats(once, "id") is once and C.drop_repeats(df.limit(0), "id").count() == 0


def test_ledger_rows_do_not_depend_on_the_layout(spark, monkeypatch):
    t = N.Tables(spark, FOLDER)
    few = N.costs_in(t)
    monkeypatch.setattr(N, "LEDGER_ROWS", 300)      # more ranges than shuffle partitions
    many = N.costs_in(t)
    assert few.count() == t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").distinct().count()
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()
    # rows of one supplier lie side by side, and a supplier with many rows is split
    places = many.withColumn("p", F.spark_partition_id()).groupBy("supplier_name").agg(F.countDistinct("p").alias("n")).agg(F.max("n"), F.min("n")).first()
    assert 1 < places[0] <= 4 and places[1] <= 3


def test_ledger_of_empty_tables(spark, tmp_path):
    source = N.Tables(spark, FOLDER)
    for name in ("lineitem", "orders", "supplier"):
        getattr(source, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert RUN["d38_cost_by_utm"](N.Tables(spark, str(tmp_path))).count() == 0


def test_lift(spark):
    df = spark.createDataFrame([(0, 10.0, "A")] * 4 + [(1, 5.0, "A")] * 2, "is_control int, v double, os string")
    r = C.lift(df, ["v"]).first()
    assert r["dif_v"] == pytest.approx((40 - 10 * 2) / (40 + 10 * 2))
    only = C.lift(df.filter("is_control = 0"), ["v"]).first()
    assert only["dif_v"] is None


def test_category_groups(spark):
    df = spark.createDataFrame([("Canais x",), ("B2B Services",), ("Other",)], "category_name string")
    assert [r[0] for r in df.select(C.category_group()).collect()] == ["PERFORMANCE", "B2B", "Other"]


def test_rate_removal_effect_equals_plain_python(spark):
    import random
    from collections import Counter, defaultdict

    rnd, rows = random.Random(3), []
    for g in range(60):
        won = rnd.randint(0, 1)
        rows += [(g, 0, rnd.choice("aabcd") if g else "z", won) for _ in range(rnd.randint(1, 6))]
    df = spark.createDataFrame(rows, "gid long, conv_group long, utm_hash string, cv_marker int").withColumn("half", F.col("gid") % 2)
    seen, hit, paths = Counter(r[2] for r in rows), Counter(r[2] for r in rows if r[3]), defaultdict(list)
    for g, _, m, won in rows:
        paths[g].append(m)
    rate, base = {m: hit[m] / n for m, n in seen.items()}, sum(hit.values()) / len(rows)
    won = {r[0]: r[3] for r in rows}
    score = lambda ms: sum(rate[m] for m in ms) / len(ms) if ms else base

    def median(v):
        v = sorted(v)
        return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2

    for by in ([], ["half"]):
        want = {}
        for m in seen:
            for k in ({0, 1} if by else {None}):
                mine = [g for g in paths if m in paths[g] and k in (None, g % 2)]
                if seen[m] > 6 and mine:
                    good = [g for g in mine if won[g]]
                    a, b = median([score(paths[g]) for g in good]), median([score([x for x in paths[g] if x != m]) for g in good])
                    want[(m, k) if by else m] = (len(mine), (b - a) / a)
        got = {((r["medium"], r["half"]) if by else r["medium"]): (r["n_occ"], r["rm_eff"]) for r in A.rate_removal_effect(df, 6, by).collect()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], abs_tol=1e-9) for k in want)
