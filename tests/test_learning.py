import numpy as np
import pytest
from pyspark.sql import functions as F

from visitloom.operators.ml import encode as E
from visitloom.operators.ml import evaluate as V
from visitloom.operators.ml import hmm as H
from visitloom.operators.ml import models as M
from visitloom.operators.ml import survival as S


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    s = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    return spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "id int, label int, score double").cache()


def test_auc_counts_ties_half(scored):
    rows = scored.collect()
    pos, neg = [r["score"] for r in rows if r["label"]], [r["score"] for r in rows if not r["label"]]
    want = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
    assert V.auc(scored).first()["auc"] == pytest.approx(want)


def test_sweep_matches_direct_counting(scored):
    rows = scored.collect()
    for r in V.threshold_sweep(scored, n=17).collect():
        chosen = [x["label"] for x in rows if x["score"] >= r["threshold"]]
        assert r["precision"] == pytest.approx(np.mean(chosen) if chosen else 0)
    best = V.best_f1(V.threshold_sweep(scored)).first()
    assert 0 < best["f1"] <= 1


def test_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "label int, prediction int")
    got = {r["class"]: (r["precision"], r["recall"], r["support"]) for r in V.class_report(df).collect()}
    assert got == {0: (0.5, 1.0, 1), 1: (0.0, 0.0, 1), 2: (1.0, 1.0, 1)}


def test_quantile_transform_interpolates(spark):
    tr = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4)], "x double")
    df = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 4.0, 9.0)], "x double")
    got = {r["x"]: r["x_q"] for r in E.quantile_transform(tr, df, "x").collect()}
    assert got == {-1.0: 0.0, 0.0: 0.0, 0.5: 0.125, 4.0: 1.0, 9.0: 1.0}


def test_target_encoding_of_rare_and_unknown(spark):
    tr = spark.createDataFrame([("a", 1.0)] * 30 + [("b", 0.0)] * 30 + [("c", 1.0)], "k string, label double")
    df = spark.createDataFrame([("a",), ("c",), ("new",)], "k string")
    got = {r["k"]: r["k_te"] for r in E.target_encode(tr, df, ["k"], "label").collect()}
    prior = 31 / 61
    pull = 1 / (1 + np.exp(-2))
    assert got["c"] == got["new"] == pytest.approx(prior) and got["a"] == pytest.approx(prior * (1 - pull) + pull)


def test_survival_and_concordance(spark):
    rows = [(1, 1, 5.0), (2, 0, 1.0), (3, 1, 3.0), (3, 1, 2.0), (5, 0, 2.5)]
    df = spark.createDataFrame(rows, "week int, event int, risk double")
    surv = {r["week"]: r["survival"] for r in S.survival_table(df).collect()}
    assert surv[1] == pytest.approx(0.8) and surv[3] == pytest.approx(0.8 / 3) and surv[5] == pytest.approx(0.8 / 3)
    pairs = good = 0
    for w, e, r in rows:
        for w2, _, r2 in rows:
            if e and w < w2:
                pairs, good = pairs + 1, good + (r > r2) + 0.5 * (r == r2)
    got = S.concordance(df, "risk").first()
    assert got["pairs"] == pairs and got["c_index"] == pytest.approx(good / pairs)


def test_everyone_bought(spark):
    df = spark.createDataFrame([(1, 1), (2, 1)], "week int, event int")
    assert {r["week"]: r["survival"] for r in S.survival_table(df).collect()} == {1: 0.5, 2: 0.0}


@pytest.fixture(scope="module")
def views(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(12):
        state = 0
        for pos in range(1, 40):
            state = state if rng.random() < 0.9 else 1 - state
            rows.append((k, pos, int(rng.poisson([1, 9][state]))))
    return spark.createDataFrame(rows, "k int, pos int, n_views int").cache()


def test_hidden_states_do_not_depend_on_the_cut(views):
    whole, h1 = H.hmm_fit(views, ["k"], states=2, iters=4, part_len=1000)
    cut, h2 = H.hmm_fit(views, ["k"], states=2, iters=4, part_len=7)
    assert np.allclose(whole.trans, cut.trans) and np.allclose(whole.rates, cut.rates)
    assert h1 == sorted(h1) and np.allclose(h1, h2)
    assert abs(whole.rates[0] - 1) < 0.5 and abs(whole.rates[1] - 9) < 1.5
    key = lambda n: sorted(map(tuple, H.hmm_decode(views, whole, ["k"], part_len=n).select("k", "pos", "state").collect()))
    assert key(1000) == key(7)


def test_batch_score_shape(spark, scored):
    df = scored.withColumn("x", F.col("score"))
    model = M.fit("logistic", df, M.feature_stages(["x"]))
    out = M.batch_score({"15": model, "30": model}, df, "id")
    assert out.columns == ["id", "pred_15", "conf_15", "pred_30", "conf_30"] and out.count() == 400
    assert {r[0] for r in out.select("pred_15").distinct().collect()} <= {"no", "yes"}


def plain_neighbour_information(x, y, k):
    """sum over rows, each compared with all rows."""
    psi = lambda m: sum(1 / i for i in range(1, int(m))) - 0.5772156649015329
    rows, total = [], 0.0
    for c in set(y):
        mine = [v for v, t in zip(x, y) if t == c]
        if len(mine) > 1:
            rows += [(v, sorted(abs(v - w) for w in mine)[min(k, len(mine) - 1)], len(mine)) for v in mine]
    every = [v for v, _, _ in rows]
    for v, r, size in rows:
        m = sum(abs(v - w) < r for w in every) if r > 0 else every.count(v)
        total += psi(min(k, size - 1)) - psi(size) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows))


@pytest.mark.parametrize("min_rows", [None, 20])
def test_nearest_neighbour_information(spark, min_rows):
    rng = np.random.default_rng(8)
    y = [*rng.integers(0, 3, 150).tolist(), 9]                  # class 9 has one row
    x = [float(v) for v in np.round(rng.normal(0, 30, 151) + 40 * np.array(y))]
    z = [float(v) for v in rng.integers(0, 4, 151)]
    df = spark.createDataFrame([(i, a, b, c) for i, (a, b, c) in enumerate(zip(x, z, y))] + [(999, None, 1.0, 0)], "id int, x double, z double, y int")
    got = {r.feature: (r.mi, r.total_correlation) for r in V.nearest_mutual_info(df, ["x", "z"], "y", "id", min_rows=min_rows).collect()}
    want = plain_neighbour_information(x, y, 3)
    assert got["x"][0] == pytest.approx(want, abs=1e-9) and want > 0.3
    assert got["x"][1] == pytest.approx(np.sqrt(1 - np.exp(-2 * want)))
    assert got["z"][0] == pytest.approx(plain_neighbour_information(z + [1.0], y + [0], 3), abs=1e-9)


def test_document_vectors_have_length_one(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", "rare"]), (2, ["b", "c"]), (3, []), (4, ["other"])], "doc int, words array<string>")
    vocab = M.vocabulary(df, "doc", "words", 3)
    assert [r.term for r in vocab.orderBy("index").collect()] == ["a", "b", "c"]
    rows = M.document_vectors(df, "doc", "words", vocab, 4)
    got = {}
    for r in rows.collect():
        got.setdefault(r.doc, {})[r.term] = r.weight
    raw = np.array([2 * (np.log(5 / 2) + 1), np.log(5 / 3) + 1])
    assert set(got) == {1, 2} and np.allclose([got[1]["a"], got[1]["b"]], raw / np.linalg.norm(raw))
    vec = M.as_features(rows, "doc", 3).filter("doc = 1").first()["features"]
    assert vec.size == 3 and vec[2] == 0 and vec.norm(2) == pytest.approx(1)
