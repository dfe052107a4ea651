"""Proportional hazards against a partial likelihood that compares every pair of customers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitloom.operators.ml import hazard as Z

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(4)
    n = 300
    x = np.column_stack([rng.normal(size=n), rng.normal(size=n) * 40, rng.integers(0, 2, n)]).astype(float)
    t = np.ceil(rng.exponential(10 * np.exp(-(x @ np.array([0.5, -0.005, 0.8]))))).astype(int)
    cut = rng.integers(1, 20, n)
    event, week = (t <= cut).astype(int), np.minimum(t, cut)
    df = spark.createDataFrame([(i, int(week[i]), int(event[i]), *map(float, x[i])) for i in range(n)], "id long, week long, event int, a double, b double, c double")
    return df.repartition(5).cache(), x, week, event


def brute(x, week, event, beta):
    xb, ll, grad, info = x @ beta, 0.0, np.zeros(len(beta)), np.zeros((len(beta),) * 2)
    for i in np.flatnonzero(event):
        at_risk = week >= week[i]
        w = np.exp(xb[at_risk])
        mean = (w[:, None] * x[at_risk]).sum(0) / w.sum()
        ll += xb[i] - np.log(w.sum())
        grad += x[i] - mean
        info += np.einsum("i,ij,ik->jk", w, x[at_risk], x[at_risk]) / w.sum() - np.outer(mean, mean)
    return ll, grad, info


def newton(x, week, event):
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        _, grad, info = brute(x, week, event, beta)
        beta = beta + np.linalg.solve(info, grad)
    return beta


def test_coefficients_maximise_the_partial_likelihood(study):
    df, x, week, event = study
    model = Z.fit_hazard(df, NAMES)
    want = newton(x, week, event)
    assert model.converged and np.allclose(model.coefficients, want, rtol=1e-7)
    ll, grad = Z.partial_likelihood(df, Z.HazardModel(tuple(NAMES), (0.1, 0.01, -0.2), (0.0, 0.0, 0.0), 0, 0, True))
    ll0, grad0, _ = brute(x, week, event, np.array([0.1, 0.01, -0.2]))
    assert ll == pytest.approx(ll0) and np.allclose(grad, grad0)


def test_folds_share_passes(study):
    df, x, week, event = study
    rows = Z.usable(df, NAMES, fold=F.col("id") % 3)
    specs = [Z.Spec(("a", "c"), 1), Z.Spec(("b",), 2), Z.Spec(("a",))]
    models = Z.fit_many(rows, specs)
    for s, m in zip(specs, models):
        seen = np.ones(len(x), bool) if s.held is None else np.arange(len(x)) % 3 != s.held
        mine = x[seen][:, [NAMES.index(f) for f in s.features]]
        assert np.allclose(m.coefficients, newton(mine, week[seen], event[seen]), rtol=1e-6)


def test_baseline_and_survival(study):
    df, x, week, event = study
    model = Z.HazardModel(("a", "c"), (0.4, -0.3), (0.1, 0.5), 0, 0, True)
    risk = np.exp((x[:, [0, 2]] - [0.1, 0.5]) @ np.array([0.4, -0.3]))
    base = Z.baseline_hazard(df, model)
    total = 0.0
    for r in base.orderBy("week").collect():
        total += event[week == r.week].sum() / risk[week >= r.week].sum()
        assert r.cumulative == pytest.approx(total)
    row = Z.survival_of(model, base, df, "id", weeks=(0, 4)).filter("id = 7").first()
    four = sum(event[week == w].sum() / risk[week >= w].sum() for w in range(1, 5))
    assert row.w0 == 1.0 and row.w4 == pytest.approx(np.exp(-four * risk[7]))


def c_index(risk, week, event):
    good = pairs = 0
    for i in np.flatnonzero(event):
        later = week > week[i]
        pairs += later.sum()
        good += (risk[later] < risk[i]).sum() + 0.5 * (risk[later] == risk[i]).sum()
    return good / pairs


def test_grid_concordance_equals_pairwise_counting(study):
    df, x, week, event = study
    rows = Z.usable(df, NAMES, fold=F.col("id") % 3)
    fold = np.arange(len(x)) % 3
    grid = {(r.k, r.fold): r for r in Z.selection_grid(rows, NAMES, [1, 2, 3], 3).collect()}
    assert len(grid) == 9
    for (k, held), r in grid.items():
        seen, names = fold != held, r.features.split(",")
        single = {f: c_index(np.sign(newton(x[seen][:, [j]], week[seen], event[seen])) * x[seen][:, j], week[seen], event[seen]) for j, f in enumerate(NAMES)}
        assert names == sorted(NAMES, key=lambda f: (-round(single[f], 12), f))[:k]
        at = [NAMES.index(f) for f in names]
        beta = newton(x[seen][:, at], week[seen], event[seen])
        assert r.c_index == pytest.approx(c_index(x[~seen][:, at] @ beta, week[~seen], event[~seen]))
    best = Z.best_k(Z.selection_grid(rows, NAMES, [1, 3], 3)).filter("rank = 1").first()
    assert best.mean_c_index == pytest.approx(max(np.mean([grid[k, h].c_index for h in range(3)]) for k in (1, 3)))


def test_degenerate_inputs(spark, study):
    df = study[0].withColumn("same", F.lit(3.0)).withColumn("twice", F.col("a") * 2)
    model = Z.fit_hazard(df, ["a", "same", "twice"])
    single = Z.fit_hazard(df, ["a"])
    assert model.coefficients[1] == 0 and model.coefficients[0] + 2 * model.coefficients[2] == pytest.approx(single.coefficients[0])
    empty = Z.fit_hazard(df.filter("week < 0"), ["a"])
    assert empty.coefficients == (0.0,) and not empty.converged
    part = study[0].withColumn("a", F.when(F.col("id") % 10 > 0, F.col("a")))
    assert Z.usable(part, ["a"]).count() == 270
    named, made = Z.dummies(spark.createDataFrame([("x", 1), ("y.z", 2), (None, 3)], "g string, n int"), ["g"])
    assert made == ["g=y.z"] and [r[2] for r in named.orderBy("n").collect()] == [0.0, 1.0, 0.0]
