"""Hidden engagement states behind per-visit view counts (Poisson emissions).

Paths are cut into parts of at most ``part_len`` visits. The forward and backward passes of a part
need only two short vectors from its neighbours, which come from the product of the neighbours'
step matrices, so an arbitrarily long path is still fitted exactly and spread over tasks. The best path works the
same way with (max, +) products. All parts of a batch step together, one array operation per visit number.

A model may fix its topology: starts, moves and ends of probability 0 stay forbidden, and with end
probabilities a path must leave the states after its last visit. A path that a topology rules out takes no part in
a fit and has no best path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.functions.ordered import quantiles
from visitloom.session import settle

VISITS = 1 << 18               # visits of a batch that step together
SCORE = 1 << 20                # best paths compare log probabilities in units of 2^-20, exactly
NEVER = -(1 << 50)


@dataclass(frozen=True)
class HmmParams:
    """``end``: probability to leave from each state (with it, rows of ``trans`` and ``end`` sum to 1); None: no end state."""

    start: np.ndarray
    trans: np.ndarray
    rates: np.ndarray
    end: np.ndarray | None = None

    @property
    def states(self) -> int:
        return len(self.start)


def initial_params(states: int, mean: float) -> HmmParams:
    """Sticky transitions and rates spread around the overall mean."""
    trans = np.full((states, states), 0.3 / max(states - 1, 1))
    np.fill_diagonal(trans, 0.7)
    trans /= trans.sum(axis=1, keepdims=True)
    rates = max(mean, 1e-3) * (np.arange(states) + 0.5) * 2.0 / states
    return HmmParams(np.full(states, 1.0 / states), trans, rates)


def topology(start, moves, end, rates) -> HmmParams:
    """A model of weights for starts, moves and ends (0: forbidden), scaled to probabilities."""
    start, moves, end = (np.asarray(v, float) for v in (start, moves, end))
    out = moves.sum(axis=1) + end
    return HmmParams(start / start.sum(), moves / out[:, None], np.asarray(rates, float), end / out)


@dataclass
class _Batch:
    """Parts that step together, longest first, their visits end to end."""

    rows: np.ndarray           # places in the caller's order
    lengths: np.ndarray
    at: np.ndarray             # first visit of each part
    obs: np.ndarray
    first: np.ndarray          # starts its path
    last: np.ndarray           # ends its path

    def steps(self) -> Iterator[tuple[int, int]]:
        """(visit number, parts that have it)."""
        for t in range(int(self.lengths[0]) if len(self.lengths) else 0):
            yield t, int(np.searchsorted(-self.lengths, -t, "left"))

    def openings(self) -> np.ndarray:
        """The visits that open a path."""
        return self.at[self.first]

    def endings(self) -> np.ndarray:
        return (self.at + self.lengths - 1)[self.last]


def _batches(obs: pd.Series, part: pd.Series, last: pd.Series) -> Iterator[_Batch]:
    sizes = np.array([len(o) for o in obs], np.int64)
    order = np.argsort(-sizes, kind="stable")
    ends = np.searchsorted(np.cumsum(sizes[order]), np.arange(VISITS, sizes.sum() + VISITS, VISITS), "right") if len(order) else []
    for cut in np.split(order, np.unique(np.clip(ends, 1, len(order)))) if len(order) else []:
        if len(cut):
            n = sizes[cut]
            flat = np.concatenate([np.asarray(obs.iloc[i], float) for i in cut])
            yield _Batch(cut, n, np.concatenate([[0], np.cumsum(n)[:-1]]), flat, part.to_numpy()[cut] == 0, last.to_numpy(bool)[cut])


def _log_emissions(obs: np.ndarray, rates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log Poisson likelihood per visit and state, less each visit's largest; and those (both without the factorial)."""
    logp = obs[:, None] * np.log(rates)[None, :] - rates[None, :]
    top = logp.max(axis=1)
    return logp - top[:, None], top


def _scaled(x: np.ndarray) -> np.ndarray:
    total = x.sum(axis=-1, keepdims=True)
    return x / np.where(total > 0, total, 1)


def _passes(b: _Batch, alpha_in: np.ndarray, beta_out: np.ndarray, p: HmmParams):
    """Entering and backward vectors, posteriors (0 for impossible paths) by visit, likelihood by part, expected moves."""
    k, n = p.states, len(b.obs)
    rel, top = _log_emissions(b.obs, p.rates)
    emit = np.exp(rel)
    alpha, beta, entering = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
    loglik = np.zeros(len(b.lengths))
    a = alpha_in.copy()
    for t, m in b.steps():
        at = b.at[:m] + t
        entering[at] = a[:m]
        new = (a[:m] @ p.trans) * emit[at]
        if t == 0:
            new[b.first] = p.start * emit[at[b.first]]
        total = new.sum(axis=1)
        with np.errstate(divide="ignore"):
            loglik[:m] += np.log(total)
        a[:m] = alpha[at] = new / np.where(total > 0, total, 1)[:, None]
    back = beta_out.copy()
    for t, m in reversed(list(b.steps())):
        at = b.at[:m] + t
        beta[at] = back[:m]
        back[:m] = _scaled((emit[at] * back[:m]) @ p.trans.T)
    if p.end is not None:
        with np.errstate(divide="ignore"):
            loglik[b.last] += np.log((alpha[b.endings()] * p.end).sum(axis=1))
    gamma = _scaled(alpha * beta)
    moved = (entering @ p.trans) * emit * beta
    z = moved.sum(axis=1)
    moving = z > 0
    moving[b.openings()] = False
    moves = p.trans * ((entering[moving] / z[moving, None]).T @ (emit[moving] * beta[moving]))
    return gamma, loglik, top, moves


def _product(b: _Batch, p: HmmParams) -> np.ndarray:
    """The product of each part's step matrices, scaled."""
    emit = np.exp(_log_emissions(b.obs, p.rates)[0])
    out = np.repeat(np.eye(p.states)[None], len(b.lengths), 0)
    for t, m in b.steps():
        at = b.at[:m] + t
        new = (out[:m] @ p.trans) * emit[at][:, None, :]
        if t == 0:
            new[b.first] = (p.start * emit[at[b.first]])[:, None, :]
        total = new.sum(axis=(1, 2), keepdims=True)
        out[:m] = new / np.where(total > 0, total, 1)
    return out


def _chain(first: np.ndarray, step: Callable, items: list) -> list[np.ndarray]:
    """What enters each of a path's parts: ``first``, then ``step`` over the parts before."""
    out, v = [], first
    for m in items:
        out.append(v)
        v = step(v, m)
    return out


def _many(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The parts of paths longer than one part."""
    return parts.join(parts.filter(F.col("part") > 0).select(*keys).distinct(), keys, "left_semi")


def _has_long(parts: DataFrame) -> bool:
    return bool(parts.agg(F.max("part")).first()[0])


def _key_schema(parts: DataFrame, keys: list[str]) -> str:
    types = dict(parts.dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in [*keys, "part"])


def _with_carry(parts: DataFrame, keys: list[str], p: HmmParams) -> DataFrame:
    """Parts with the vectors that enter them from both sides."""
    k = p.states
    leave = np.ones(k) if p.end is None else p.end
    uniform, out = F.array(*[F.lit(1.0 / k)] * k), F.array(*[F.lit(float(v)) for v in leave])
    if not _has_long(parts):
        return parts.withColumns({"alpha_in": uniform, "beta_out": out})

    @F.pandas_udf("array<double>")
    def product(obs: pd.Series, part: pd.Series, last: pd.Series) -> pd.Series:
        made = np.empty(len(obs), object)
        for b in _batches(obs, part, last):
            for i, m in zip(b.rows, _product(b, p)):
                made[i] = m.ravel()
        return pd.Series(made)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        # one small matrix per part of one path
        pdf = pdf.sort_values("part").reset_index(drop=True)
        ms = [np.asarray(m).reshape(k, k) for m in pdf["m"]]
        pdf["alpha_in"] = _chain(np.full(k, 1.0 / k), lambda a, m: _scaled(a @ m), ms)
        pdf["beta_out"] = _chain(leave, lambda v, m: _scaled(m @ v), ms[::-1])[::-1]
        return pdf.drop(columns=["m"])

    summaries = _many(parts, keys).select(*keys, "part", product("obs", "part", "last").alias("m"))
    carry = summaries.groupBy(*keys).applyInPandas(chain, f"{_key_schema(parts, keys)}, alpha_in array<double>, beta_out array<double>")
    return (parts.join(carry, [*keys, "part"], "left")
            .withColumns({"alpha_in": F.coalesce("alpha_in", uniform), "beta_out": F.coalesce("beta_out", out)}))


PART_LEN, MAX_PARTS = 10_000, 20_000


def part_length(df: DataFrame, pos: str) -> int:
    """Visits per part: grows with the longest path, so that no path has more than MAX_PARTS parts."""
    longest = df.agg(F.max(pos)).first()[0] or 1
    return max(PART_LEN, -(-longest // MAX_PARTS))


def to_parts(df: DataFrame, keys, pos: str, obs: str, part_len: int | None = None) -> DataFrame:
    part_len = part_len or part_length(df, pos)
    part = F.floor((F.col(pos) - 1) / part_len)
    rows = df.groupBy(*keys, part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(obs).cast("double").alias("o")))).alias("v"))
    rows = rows.select(*keys, "part", F.col("v.p").alias("pos"), F.col("v.o").alias("obs"))
    return rows.withColumn("last", F.col("part") == F.max("part").over(W.partitionBy(*keys)))


def hmm_fit(df: DataFrame, keys, pos: str = "pos", obs: str = "n_views", states: int = 4, iters: int = 100,
            part_len: int | None = None, start: HmmParams | None = None, gain: float = 0.1) -> tuple[HmmParams, list[float]]:
    """Expectation-maximisation; returns the parameters and the log-likelihood (up to a constant)
    seen by each iteration. Each round brings a few dozen sums to the driver.

    Ends when a round gains less than ``gain`` in log-likelihood, after ``iters`` rounds at the latest. ``start`` gives
    the first parameters and the topology; without it every move is allowed.
    """
    keys = list(keys)
    parts = settle(to_parts(df, keys, pos, obs, part_len))
    p, history = start or initial_params(states, float(df.agg(F.avg(obs)).first()[0] or 1.0)), []
    k = p.states
    may = [p.start > 0, p.trans > 0, np.ones(k, bool) if p.end is None else p.end > 0]
    for _ in range(iters):
        cur = p

        def expected(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(k * k + 4 * k + 1)
            for f in frames:
                a_in, b_out = np.stack(f["alpha_in"]), np.stack(f["beta_out"])
                for b in _batches(f["obs"], f["part"], f["last"]):
                    gamma, ll, top, moves = _passes(b, a_in[b.rows], b_out[b.rows], cur)
                    shift = np.add.reduceat(top, b.at)
                    fine = gamma[b.at].sum(axis=1) > 0
                    total += np.concatenate([
                        moves.ravel(), gamma[b.openings()].sum(0), gamma[b.endings()].sum(0), gamma.sum(0),
                        (gamma * b.obs[:, None]).sum(0), [(ll + shift)[fine].sum()]])
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

        rows = _with_carry(parts, keys, p).select("obs", "part", "last", "alpha_in", "beta_out")
        sums = rows.mapInPandas(expected, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        v = np.zeros(k * k + 4 * k + 1)
        for r in sums:
            v[r["i"]] = r["v"]
        moves, begin, leave, g, go = v[:k * k].reshape(k, k), *v[k * k:-1].reshape(4, k)
        history.append(float(v[-1]))
        moves, begin = (moves + 1e-6) * may[1], (begin + 1e-6) * may[0]
        out = moves.sum(axis=1)
        if p.end is not None:
            leave = (leave + 1e-6) * may[2]
            out = out + leave
        p = HmmParams(begin / begin.sum(), moves / out[:, None], np.maximum(go / np.maximum(g, 1e-12), 1e-3), None if p.end is None else leave / out)
        if len(history) > 1 and history[-1] - history[-2] < gain:
            break
    return p, history


def hmm_decode(df: DataFrame, params: HmmParams, keys, pos: str = "pos", obs: str = "n_views",
               part_len: int | None = None) -> DataFrame:
    """Most probable state and its posterior for every visit; null where the topology rules the path out."""
    keys = list(keys)
    parts = to_parts(df, keys, pos, obs, part_len)

    @F.pandas_udf("array<struct<state int, posterior double>>")
    def decode(obs_s: pd.Series, part: pd.Series, last: pd.Series, a: pd.Series, b_out: pd.Series) -> pd.Series:
        made, a, b_out = np.empty(len(obs_s), object), np.stack(a), np.stack(b_out)
        for b in _batches(obs_s, part, last):
            gamma = _passes(b, a[b.rows], b_out[b.rows], params)[0]
            best, sure = gamma.argmax(axis=1), gamma.max(axis=1)
            for i, at, n in zip(b.rows, b.at, b.lengths):
                made[i] = [{"state": int(s), "posterior": float(g)} if g > 0 else {"state": None, "posterior": None}
                           for s, g in zip(best[at: at + n], sure[at: at + n])]
        return pd.Series(made)

    rows = _with_carry(parts, keys, params).withColumn("_d", decode("obs", "part", "last", "alpha_in", "beta_out"))
    return rows.select(*keys, F.inline(F.arrays_zip(F.col("pos"), F.col("obs"), F.col("_d.state").alias("state"),
                                                    F.col("_d.posterior").alias("posterior"))))


def _units(p: np.ndarray) -> np.ndarray:
    """Log probabilities in whole units, NEVER for 0."""
    with np.errstate(divide="ignore"):
        x = np.log(p)
    return np.where(np.isfinite(x), np.floor(np.where(np.isfinite(x), x, 0) * SCORE + 0.5), NEVER).astype(np.int64)


def _scores(obs: np.ndarray, rates: np.ndarray) -> np.ndarray:
    return np.floor(_log_emissions(obs, rates)[0] * SCORE + 0.5).astype(np.int64)


def _level(x: np.ndarray) -> np.ndarray:
    """Scores relative to the best of the last axes; impossible ones back at NEVER."""
    top = x.max(axis=tuple(range(1, x.ndim)), keepdims=True)
    return np.where(x < NEVER // 2, NEVER, x - np.where(top < NEVER // 2, 0, top))


def _best_step(v: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best score to each state and the first state that gives it, over the last axis of ``v``."""
    each = v[..., :, None] + trans
    return each.max(axis=-2), each.argmax(axis=-2)


def _best_product(b: _Batch, p: HmmParams) -> np.ndarray:
    """(max, +) product of each part's steps: best score from an entering state to the last visit's state."""
    k, trans, emit = p.states, _units(p.trans), _scores(b.obs, p.rates)
    out = np.where(np.eye(k, dtype=bool), 0, NEVER)[None].repeat(len(b.lengths), 0)
    for t, m in b.steps():
        at = b.at[:m] + t
        new = _best_step(out[:m], trans)[0] + emit[at][:, None, :]
        if t == 0:
            new[b.first] = (_units(p.start) + emit[at[b.first]])[:, None, :]
        out[:m] = _level(new)
    return out


def _best_scan(b: _Batch, v_in: np.ndarray, p: HmmParams) -> tuple[np.ndarray, np.ndarray]:
    """Scores after each part, and for each visit and state the state before."""
    trans, emit = _units(p.trans), _scores(b.obs, p.rates)
    v, before = v_in.copy(), np.zeros((len(b.obs), p.states), np.int8)
    for t, m in b.steps():
        at = b.at[:m] + t
        best, before[at] = _best_step(v[:m], trans)
        new = best + emit[at]
        if t == 0:
            new[b.first] = _units(p.start) + emit[at[b.first]]
        v[:m] = _level(new)
    return v, before


def hmm_best_path(df: DataFrame, params: HmmParams, keys, pos: str = "pos", obs: str = "n_views",
                  part_len: int | None = None) -> DataFrame:
    """The most probable sequence of states of every path, one row per visit; null where none is possible.

    Of equally probable ones, the path that is smallest read from its end. Scores are whole units of
    2^-20 in the logarithm, so sums do not depend on where a path is cut into parts. Long paths take three
    passes: best products per part, chained to the scores that enter each part; the state entered for every
    state left, chained backwards to the state each part leaves in; and the way back inside each part.
    """
    keys = list(keys)
    k = params.states
    parts = settle(to_parts(df, keys, pos, obs, part_len))
    leave = np.zeros(k, np.int64) if params.end is None else _units(params.end)
    entry = F.array(*[F.lit(0).cast("long")] * k)
    parts = parts.withColumns({"v_in": entry, "leaves": F.lit(None).cast("int")})
    if _has_long(parts):
        @F.pandas_udf("array<long>")
        def product(obs_s: pd.Series, part: pd.Series, last: pd.Series) -> pd.Series:
            made = np.empty(len(obs_s), object)
            for b in _batches(obs_s, part, last):
                for i, m in zip(b.rows, _best_product(b, params)):
                    made[i] = m.ravel()
            return pd.Series(made)

        def forward(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part").reset_index(drop=True)
            ms = [np.asarray(m).reshape(k, k) for m in pdf["m"]]
            pdf["v_in"] = _chain(np.zeros(k, np.int64), lambda v, m: _level((v[:, None] + m).max(axis=0)[None])[0], ms)
            return pdf.drop(columns=["m"])

        @F.pandas_udf("array<long>")
        def entered(obs_s: pd.Series, part: pd.Series, last: pd.Series, v_in: pd.Series) -> pd.Series:
            """For each state left, the state entered; then the scores after the part."""
            made, v_in = np.empty(len(obs_s), object), np.stack(v_in)
            for b in _batches(obs_s, part, last):
                after, before = _best_scan(b, v_in[b.rows], params)
                origin = np.tile(np.arange(k), (len(b.rows), 1))
                for t, m in b.steps():
                    origin[:m] = np.take_along_axis(origin[:m], before[b.at[:m] + t].astype(np.int64), 1)
                for i, row in zip(b.rows, np.hstack([origin, after])):
                    made[i] = row
            return pd.Series(made)

        def backward(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part").reset_index(drop=True)
            e = np.stack(pdf["e"])
            final = e[-1, k:] + leave
            state, out = (int(final.argmax()) if final.max() > NEVER // 2 else -1), []
            for row in e[::-1]:
                out.append(state)
                state = int(row[state]) if state >= 0 else -1
            pdf["leaves"] = out[::-1]
            return pdf.drop(columns=["e"])

        many = _many(parts, keys).drop("v_in", "leaves")
        keyed = _key_schema(parts, keys)
        scores = many.select(*keys, "part", product("obs", "part", "last").alias("m")).groupBy(*keys).applyInPandas(forward, f"{keyed}, v_in array<long>")
        many = settle(many.join(scores, [*keys, "part"]))
        ends = many.select(*keys, "part", entered("obs", "part", "last", "v_in").alias("e")).groupBy(*keys).applyInPandas(backward, f"{keyed}, leaves int")
        known = many.select(*keys, "part", "v_in").join(ends, [*keys, "part"])
        parts = parts.drop("v_in", "leaves").join(known, [*keys, "part"], "left").withColumn("v_in", F.coalesce("v_in", entry))

    @F.pandas_udf("array<int>")
    def path(obs_s: pd.Series, part: pd.Series, last: pd.Series, v_in: pd.Series, leaves: pd.Series) -> pd.Series:
        made, v_in, leaves = np.empty(len(obs_s), object), np.stack(v_in), leaves.fillna(-2).to_numpy(np.int64)
        for b in _batches(obs_s, part, last):
            after, before = _best_scan(b, v_in[b.rows], params)
            final = after + leave
            state = np.where(final.max(axis=1) > NEVER // 2, final.argmax(axis=1), -1)
            state = np.where(leaves[b.rows] > -2, leaves[b.rows], state)
            states = np.full(len(b.obs), -1)
            for t, m in reversed(list(b.steps())):
                at = b.at[:m] + t
                states[at] = state[:m]
                state[:m] = np.where(state[:m] >= 0, before[at, np.maximum(state[:m], 0)], -1)
            for i, at, n in zip(b.rows, b.at, b.lengths):
                made[i] = [None if s < 0 else int(s) for s in states[at: at + n]]
        return pd.Series(made)

    rows = parts.withColumn("_s", path("obs", "part", "last", "v_in", "leaves"))
    return rows.select(*keys, F.inline(F.arrays_zip(F.col("pos"), F.col("obs"), F.col("_s").alias("state"))))


def parameter_rows(params: HmmParams) -> list[tuple[str, int, int, float]]:
    """(kind, from, to, value) of start, move, end and rate, forbidden ones included."""
    k = params.states
    out = [("start", -1, j, float(params.start[j])) for j in range(k)] + [("rate", j, -1, float(params.rates[j])) for j in range(k)]
    out += [("move", i, j, float(params.trans[i, j])) for i in range(k) for j in range(k)]
    return out + ([] if params.end is None else [("end", i, -1, float(params.end[i])) for i in range(k)])


def state_summary(decoded: DataFrame, by: str, measures) -> DataFrame:
    """Visits per group with mean and exact median of each measure."""
    out = decoded.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"mean_{m}") for m in measures])
    for m in measures:
        out = out.join(quantiles(decoded, m, [0.5], [by]).withColumnRenamed("q0", f"median_{m}"), by, "left")
    return out
