"""Proportional hazards: partial-likelihood fits, baseline hazard, selection of features by cross-validated concordance.

Everything the partial likelihood needs of the rows are sums per week: of exp(xb), x exp(xb) and xx' exp(xb) over
all rows, and of x over the events. A Newton step is one pass that adds them up in the tasks, one row per
model, week and task, and a suffix sum over the weeks for the risk sets; pairs of customers never meet.
Many models (folds, feature subsets) share the passes. Ties within a week are Breslow's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.operators.ml.survival import REPORT_WEEKS, concordance
from visitloom.session import store

HELD, FOLD = "held", "fold"


@dataclass(frozen=True)
class HazardModel:
    """``coefficients`` per unit of each feature; risks are relative to a row at the ``means``."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    means: tuple[float, ...]
    log_likelihood: float
    steps: int
    converged: bool

    def risk(self) -> Column:
        """The log hazard ratio of a row; null if a feature is."""
        out = F.lit(0.0)
        for f, b, m in zip(self.features, self.coefficients, self.means):
            out = out + F.lit(b) * (F.col(f"`{f}`").cast("double") - F.lit(m))
        return out


@dataclass(frozen=True)
class Spec:
    """A model to fit: its features, and the fold that it must not see."""

    features: tuple[str, ...]
    held: int | None = None


def dummies(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """0/1 columns ``column=level`` for every level but the first by name; null has none. Levels must be few."""
    made = []
    for c in columns:
        levels = sorted(r[0] for r in df.select(F.col(c).cast("string")).filter(F.col(c).isNotNull()).distinct().collect())
        for level in levels[1:]:
            df = df.withColumn(f"{c}={level}", F.coalesce((F.col(c).cast("string") == F.lit(level)).cast("double"), F.lit(0.0)))
            made.append(f"{c}={level}")
    return df, made


def usable(df: DataFrame, features: Sequence[str], dur: str = "week", event: str = "event", fold: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Rows with all features, a duration and an event mark, stored for the passes over them."""
    q = lambda c: F.col(f"`{c}`")
    need = [q(f).cast("double").alias(f) for f in features]
    out = df.select(*[q(k) for k in keep], q(dur).cast("long").alias("week"), q(event).cast("long").alias("event"),
                    (F.lit(0) if fold is None else fold.cast("int")).alias(FOLD), *need)
    for f in ["week", "event", FOLD, *features]:
        c = q(f)
        out = out.filter(c.isNotNull() & ~F.isnan(c.cast("double")))
    return store(out)


def _sums(features: list[str], specs: list[Spec], betas: dict[int, np.ndarray], means: np.ndarray) -> Callable:
    """One row per model and week of a task: events, then sums of x over events, of e, x e and the upper xx' e."""
    at = {f: i for i, f in enumerate(features)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for frame in frames:
            week, event, fold = (frame[c].to_numpy() for c in ("week", "event", FOLD))
            x = frame[features].to_numpy(np.float64) - means
            for m, beta in betas.items():
                spec = specs[m]
                mine = x[:, [at[f] for f in spec.features]]
                seen = np.ones(len(x), bool) if spec.held is None else fold != spec.held
                mine, w, d = mine[seen], week[seen], event[seen].astype(np.float64)
                if not len(w):
                    continue
                e = np.exp(mine @ beta)
                i, j = np.triu_indices(len(beta))
                parts = np.column_stack([d, mine * d[:, None], e, mine * e[:, None], mine[:, i] * mine[:, j] * e[:, None]])
                weeks, place = np.unique(w, return_inverse=True)
                order = np.argsort(place, kind="stable")
                starts = np.searchsorted(place[order], np.arange(len(weeks)))
                for k, row in zip(weeks.tolist(), np.add.reduceat(parts[order], starts)):
                    total[m, k] = total.get((m, k), 0) + row
        if total:
            yield pd.DataFrame({"model": [k[0] for k in total], "week": [k[1] for k in total], "sums": [v.tolist() for v in total.values()]})
    return run


def _weekly(rows: DataFrame, features: list[str], specs: list[Spec], betas: dict[int, np.ndarray], means: np.ndarray) -> dict[int, np.ndarray]:
    """Sums by week, latest week first, for each model. A row per model, week and position reaches the driver."""
    parts = rows.select("week", "event", FOLD, *[F.col(f"`{f}`") for f in features]).mapInPandas(
        _sums(features, specs, betas, means), "model int, week long, sums array<double>")
    added = (parts.select("model", "week", F.posexplode("sums").alias("pos", "v")).groupBy("model", "week", "pos").agg(F.sum("v").alias("v"))
             .groupBy("model", "week").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).getField("v").alias("sums")))
    out: dict[int, list] = {}
    for r in added.collect():
        out.setdefault(r.model, []).append((r.week, r.sums))
    return {m: np.array([s for _, s in sorted(v, key=lambda z: -z[0])]) for m, v in out.items()}


def _likelihood(sums: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Partial log likelihood, its gradient and the information matrix."""
    p = len(beta)
    d, events_x = sums[:, 0], sums[:, 1: p + 1].sum(0)
    risk = np.cumsum(sums[:, p + 1:], 0)                       # of all rows not ended before the week
    s0, s1 = risk[:, 0], risk[:, 1: p + 1]
    s2 = np.zeros((len(d), p, p))
    i, j = np.triu_indices(p)
    s2[:, i, j] = s2[:, j, i] = risk[:, p + 1:]
    some = d > 0
    d, s0, s1, s2 = d[some], s0[some], s1[some], s2[some]
    mean = s1 / s0[:, None]
    ll = float(events_x @ beta - (d * np.log(s0)).sum())
    grad = events_x - (d[:, None] * mean).sum(0)
    info = (d[:, None, None] * (s2 / s0[:, None, None] - mean[:, :, None] * mean[:, None, :])).sum(0)
    return ll, grad, info


def fit_many(rows: DataFrame, specs: list[Spec], max_steps: int = 30, tol: float = 1e-10) -> list[HazardModel]:
    """All models at once; ``rows`` comes from ``usable``. A step that lowers the likelihood is halved.

    A feature without variation, or one that others determine, gets a coefficient of 0 (least-norm step).
    """
    features = sorted({f for s in specs for f in s.features})
    if not features:
        return [HazardModel((), (), (), 0.0, 0, True) for _ in specs]
    got = rows.agg(*[F.avg(f"`{f}`") for f in features]).first()
    means = np.array([0.0 if v is None else v for v in got])
    beta = {m: np.zeros(len(s.features)) for m, s in enumerate(specs)}
    best: dict[int, tuple[float, np.ndarray, np.ndarray, np.ndarray]] = {}
    steps, done = dict.fromkeys(beta, 0), {}
    while len(done) < len(specs):
        weekly = _weekly(rows, features, specs, {m: b for m, b in beta.items() if m not in done}, means)
        for m in [m for m in beta if m not in done]:
            steps[m] += 1
            if m not in weekly:                                # no rows
                best[m], done[m] = (0.0, beta[m], None, None), False
                continue
            ll, grad, info = _likelihood(weekly[m], beta[m])
            if m in best and not ll >= best[m][0] - 1e-12 * abs(best[m][0]) and steps[m] < max_steps:
                beta[m] = (beta[m] + best[m][1]) / 2
                continue
            gain = ll - best[m][0] if m in best else np.inf
            best[m] = (ll, beta[m].copy(), grad, info)
            if gain <= tol * (1 + abs(ll)) or steps[m] >= max_steps:
                done[m] = gain <= tol * (1 + abs(ll))
                continue
            scale = np.sqrt(np.where(np.diag(info) > 1e-12, np.diag(info), 1))
            beta[m] = beta[m] + np.linalg.lstsq(info / np.outer(scale, scale), grad / scale, rcond=1e-10)[0] / scale
    where = {f: i for i, f in enumerate(features)}
    return [HazardModel(s.features, tuple(map(float, best[m][1])), tuple(float(means[where[f]]) for f in s.features), best[m][0], steps[m], done[m])
            for m, s in enumerate(specs)]


def fit_hazard(df: DataFrame, features: Sequence[str], dur: str = "week", event: str = "event") -> HazardModel:
    """One model over all rows; rows with a null in a feature, the duration or the event are left out."""
    return fit_many(usable(df, features, dur, event), [Spec(tuple(features))])[0]


def partial_likelihood(df: DataFrame, model: HazardModel) -> tuple[float, np.ndarray]:
    """Log likelihood and gradient of given coefficients over ``df`` (week, event, features)."""
    rows = usable(df, model.features)
    beta = np.array(model.coefficients)
    weekly = _weekly(rows, list(model.features), [Spec(model.features)], {0: beta}, np.array(model.means))
    ll, grad, _ = _likelihood(weekly[0], beta)
    return ll, grad


def baseline_hazard(df: DataFrame, model: HazardModel, dur: str = "week", event: str = "event") -> DataFrame:
    """week, events, at_risk (weight of the risk set), hazard and cumulative hazard of a row at the means (Breslow).

    One row per week that occurs, so the windows are bounded by the length of the study.
    """
    risk = model.risk()
    weeks = (df.filter(risk.isNotNull() & F.col(dur).isNotNull() & F.col(event).isNotNull()).groupBy(F.col(dur).cast("long").alias("week"))
             .agg(F.sum(F.col(event).cast("long")).alias("events"), F.sum(F.exp(risk)).alias("weight")))
    later = W.partitionBy(F.lit(0)).orderBy(F.col("week").desc())
    upto = W.partitionBy(F.lit(0)).orderBy("week").rowsBetween(W.unboundedPreceding, W.currentRow)
    weeks = weeks.withColumn("at_risk", F.sum("weight").over(later)).withColumn("hazard", F.col("events") / F.col("at_risk"))
    return weeks.withColumn("cumulative", F.sum("hazard").over(upto)).select("week", "events", "at_risk", "hazard", "cumulative")


def survival_of(model: HazardModel, baseline: DataFrame, df: DataFrame, id_col: str, weeks=REPORT_WEEKS, keep=()) -> DataFrame:
    """Per row, the probability to be without the event after each week: exp(-H0(week) exp(risk)), one column ``w`` per week."""
    at = baseline.agg(*[F.max(F.when(F.col("week") <= w, F.col("cumulative"))).alias(f"h{w}") for w in weeks]).first()
    risk = F.exp(model.risk())
    cols = [F.exp(-F.lit(float(at[f"h{w}"] or 0.0)) * risk).alias(f"w{w}") for w in weeks]
    return df.filter(model.risk().isNotNull()).select(id_col, *keep, *cols)


def univariate_scores(rows: DataFrame, features: Sequence[str], folds: Sequence[int | None] = (None,)) -> DataFrame:
    """held, feature, coefficient, c_index of one-feature models on the rows they were fitted on, for each left-out fold.

    A one-feature risk orders rows as the feature does, or the other way round, so concordance is counted once
    on the feature's values, and turned over for negative coefficients; a coefficient of 0 orders nothing (0.5).
    """
    specs = [Spec((f,), h) for h in folds for f in features]
    models = fit_many(rows, specs)
    entries = F.array(*[F.struct(F.lit(-1 if h is None else h).cast("int").alias(HELD), F.lit(f).alias("feature"), F.col(f"`{f}`").alias("x")) for h in folds for f in features])
    long = rows.select("week", "event", FOLD, F.explode(entries).alias("z")).select("week", "event", FOLD, "z.*").filter(F.col(FOLD) != F.col(HELD))
    table = concordance(long, "x", by=(HELD, "feature"))
    fitted = rows.sparkSession.createDataFrame(
        [(-1 if s.held is None else s.held, s.features[0], m.coefficients[0]) for s, m in zip(specs, models)], f"{HELD} int, feature string, coefficient double")
    turned = F.when(F.col("coefficient") > 0, F.col("c_index")).when(F.col("coefficient") < 0, 1 - F.col("c_index")).otherwise(0.5)
    return fitted.join(table, [HELD, "feature"], "left").withColumn("c_index", turned).drop("pairs")


def selection_grid(rows: DataFrame, features: Sequence[str], ks: Sequence[int], folds: int = 5) -> DataFrame:
    """k, held fold, the k best features by univariate concordance on the other folds, and the C-index on the held one.

    Ties between features go to the earlier name. ``rows`` comes from ``usable`` with a fold column of 0 .. folds - 1.
    All fits share passes; the chosen features, folds x features rows, come to the driver.
    """
    scores = univariate_scores(rows, features, range(folds)).collect()
    ranked = {h: [r.feature for r in sorted((r for r in scores if r[HELD] == h), key=lambda r: (-r.c_index if r.c_index is not None else 1, r.feature))] for h in range(folds)}
    specs = [Spec(tuple(ranked[h][:k]), h) for h in range(folds) for k in ks]
    models = fit_many(rows, specs)
    risks = F.array(*[F.struct(F.lit(s.held).alias(HELD), F.lit(len(s.features)).alias("k"), m.risk().alias("risk")) for s, m in zip(specs, models)])
    long = rows.select("week", "event", FOLD, F.explode(risks).alias("z")).select("week", "event", FOLD, "z.*").filter(F.col(FOLD) == F.col(HELD))
    table = concordance(long, "risk", by=(HELD, "k"))
    chosen = rows.sparkSession.createDataFrame([(s.held, len(s.features), ",".join(s.features)) for s in specs], f"{HELD} int, k int, features string")
    return chosen.join(table, [HELD, "k"], "left").select("k", F.col(HELD).alias("fold"), "features", "pairs", "c_index")


def best_k(grid: DataFrame) -> DataFrame:
    """Mean and spread of the C-index over folds by k, with the rank of the mean (ties to the smaller k)."""
    means = grid.groupBy("k").agg(F.avg("c_index").alias("mean_c_index"), F.stddev_pop("c_index").alias("std_c_index"))
    return means.withColumn("rank", F.row_number().over(W.orderBy(F.col("mean_c_index").desc_nulls_last(), "k")))
