"""Hidden states against enumeration of all state sequences, and against a plain Viterbi recursion."""

import itertools

import numpy as np
import pytest

from visitloom.operators.ml import hmm as H

# s3 is the only state to leave from, nothing moves back
FIXED = H.topology([0.5, 0.3, 0.2, 0], [[1, 1, 1, 1], [0, 1, 1, 1], [0, 0, 1, 1], [0, 0, 0, 1]], [0, 0, 0, 4], [1.0, 2.0, 4.0, 8.0])
FREE = H.initial_params(3, 4.0)
TIES = H.HmmParams(np.full(3, 1 / 3), np.full((3, 3), 1 / 3), np.array([2.0, 2.0, 5.0]))


@pytest.fixture(scope="module")
def paths(spark):
    rng = np.random.default_rng(2)
    obs = {k: rng.poisson(rng.choice([1, 3, 9]), int(rng.integers(1, 12))).tolist() for k in range(40)}
    obs[40] = rng.poisson(4, 137).tolist()
    return obs, spark.createDataFrame([(k, i + 1, float(o)) for k, os in obs.items() for i, o in enumerate(os)], "k int, pos int, n_views double").repartition(6)


def plain_path(obs, p):
    trans, emit, leave = H._units(p.trans), H._scores(np.array(obs, float), p.rates), 0 if p.end is None else H._units(p.end)
    v, back = H._units(p.start) + emit[0], []
    for e in emit[1:]:
        each = v[:, None] + trans
        back.append(each.argmax(axis=0))
        v = each.max(axis=0) + e
    v = v + leave
    if v.max() < H.NEVER // 2:
        return [None] * len(obs)
    s = int(v.argmax())
    out = [s]
    for b in back[::-1]:
        s = int(b[s])
        out.append(s)
    return out[::-1]


@pytest.mark.parametrize("params", [FIXED, FREE, TIES])
@pytest.mark.parametrize("part_len", [2, 5, 1000])
def test_best_path_equals_viterbi(paths, params, part_len):
    obs, df = paths
    got = {}
    for r in H.hmm_best_path(df, params, ["k"], part_len=part_len).orderBy("k", "pos").collect():
        got.setdefault(r.k, []).append(r.state)
    assert got == {k: plain_path(o, params) for k, o in obs.items()}


def enumerated(obs, p):
    """Likelihood (up to the factorials) and posteriors by adding up all sequences."""
    k, n = p.states, len(obs)
    total, post = 0.0, np.zeros((n, k))
    for s in itertools.product(range(k), repeat=n):
        w = p.start[s[0]] * (1 if p.end is None else p.end[s[-1]])
        for a, b in zip(s, s[1:]):
            w *= p.trans[a, b]
        for o, x in zip(obs, s):
            w *= p.rates[x] ** o * np.exp(-p.rates[x])
        total += w
        for t, x in enumerate(s):
            post[t, x] += w
    return total, post / total if total else post


@pytest.mark.parametrize("part_len", [2, 1000])
def test_posteriors_and_likelihood_equal_enumeration(paths, part_len):
    obs, df = paths
    short = {k: o for k, o in obs.items() if len(o) <= 6}
    df = df.filter(df.k.isin(list(short)))
    got = {(r.k, r.pos): r for r in H.hmm_decode(df, FIXED, ["k"], part_len=part_len).collect()}
    loglik = 0.0
    for k, o in short.items():
        total, post = enumerated(o, FIXED)
        if not total:
            assert all(got[k, t + 1].state is None for t in range(len(o)))
            continue
        loglik += np.log(total)
        for t in range(len(o)):
            assert got[k, t + 1].posterior == pytest.approx(post[t].max()) and got[k, t + 1].state == int(post[t].argmax())
    _, history = H.hmm_fit(df, ["k"], start=FIXED, iters=1, part_len=part_len)
    assert history[0] == pytest.approx(loglik)


def test_fixed_topology_stays_and_likelihood_never_falls(paths):
    _, df = paths
    p, history = H.hmm_fit(df, ["k"], start=FIXED, iters=12, gain=-1.0)
    q, h2 = H.hmm_fit(df, ["k"], start=FIXED, iters=12, gain=-1.0, part_len=3)
    assert len(history) == 12 and all(b >= a - 1e-3 for a, b in zip(history, history[1:]))
    assert np.allclose(history, h2) and np.allclose(p.trans, q.trans) and np.allclose(p.end, q.end)
    assert (p.trans[np.tril_indices(4, -1)] == 0).all() and p.start[3] == 0 and (p.end[:3] == 0).all()
    assert np.allclose(p.trans.sum(1) + p.end, 1) and p.start.sum() == pytest.approx(1)
    rows = H.parameter_rows(p)
    assert len(rows) == 4 + 4 + 16 + 4 and {r[0] for r in rows} == {"start", "rate", "move", "end"}


def test_many_batches_equal_one(paths, monkeypatch):
    _, df = paths
    parts = H.to_parts(df, ["k"], "pos", "n_views", 4).toPandas()
    whole = list(H._batches(parts["obs"], parts["part"], parts["last"]))
    monkeypatch.setattr(H, "VISITS", 20)
    cut = list(H._batches(parts["obs"], parts["part"], parts["last"]))
    assert len(whole) == 1 and len(cut) > 5 and sorted(np.concatenate([b.rows for b in cut])) == list(range(len(parts)))
    assert all((np.diff(b.lengths) <= 0).all() for b in cut)
