"""Attribution from first-order transition counts held as (from_state, to_state, cnt) rows.

Edges are the aggregate of the touches, one row per pair of states. ``prune_channels`` keeps only
channels with at least ``pct`` percent of all transitions, so at most 100/pct remain; the per-removal
computations, whose work is a power of the number of channels, start from that pruned table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.session import settle

START, END, CONVERSION = "START", "END", "CONVERSION"
TERMINAL = (END, CONVERSION)
FAKE = (START, END, CONVERSION)


def transition_probs(edges: DataFrame) -> DataFrame:
    """Share of each edge among the edges that leave the same state."""
    # a join, not a window: the rows of a state with very many targets are split at run time
    total = edges.groupBy(F.col("from_state").alias("_from")).agg(F.sum("cnt").alias("_total"))
    return edges.join(total, F.col("from_state") == F.col("_from")).withColumn("p", F.col("cnt") / F.col("_total")).drop("_from", "_total")


def heat_map(edges: DataFrame, states: list[str]) -> DataFrame:
    """Dense table for display: one row per target, one column per listed source state."""
    probs = transition_probs(edges).filter(F.col("from_state").isin(states))
    return probs.groupBy("to_state").pivot("from_state", states).agg(F.sum("p")).na.fill(0.0)


def complete(edges: DataFrame, states: list[str]) -> DataFrame:
    """All ordered pairs of the listed states, missing counts as 0."""
    rows = edges.filter(F.col("from_state").isin(states) & F.col("to_state").isin(states))
    wide = edges.sparkSession.createDataFrame([(s,) for s in states], "from_state string")
    pairs = wide.withColumn("to_state", F.explode(F.array(*[F.lit(s) for s in states])))
    return pairs.join(rows, ["from_state", "to_state"], "left").na.fill(0, ["cnt"])


def prune_channels(edges: DataFrame, pct: float = 1.0, refill: bool = True) -> DataFrame:
    """Drop channels with fewer than ``pct`` percent of outgoing transitions, from both ends.

    ``refill`` gives END and CONVERSION their edge into END, which the chain computations use.
    """
    edges = settle(edges)  # read three times below; the touches behind it only once
    out = (edges.filter(~F.col("from_state").isin(*TERMINAL))
           .groupBy("from_state").agg(F.sum("cnt").alias("n")))
    total = out.agg(F.sum("n").alias("t"))
    minor = out.filter(F.col("n") < total.scalar() * (pct / 100)).select(F.col("from_state").alias("s"))
    kept = (edges.filter(~F.col("from_state").isin(*TERMINAL))
            .join(minor, F.col("from_state") == F.col("s"), "left_anti")
            .join(minor, F.col("to_state") == F.col("s"), "left_anti"))
    if not refill:
        return kept
    ends = (kept.filter(F.col("to_state").isin(*TERMINAL)).groupBy(F.col("to_state").alias("from_state"))
            .agg(F.sum("cnt").alias("cnt")).select("from_state", F.lit(END).alias("to_state"), "cnt"))
    return kept.select("from_state", "to_state", "cnt").unionByName(ends)


def conversion_rate(edges: DataFrame) -> DataFrame:
    """One row: conversions of real channels, their mean per channel, and the overall rate."""
    live = ~F.col("from_state").isin(*TERMINAL)
    conv, exit_ = F.col("to_state") == CONVERSION, F.col("to_state") == END
    real = ~F.col("from_state").isin(*FAKE)
    s = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("cnt"))), F.lit(0))
    return edges.agg(
        s(real & conv).alias("total_cv"),
        F.try_divide(s(real & conv), F.countDistinct(F.when(real, F.col("from_state")))).alias("average_cv"),
        F.try_divide(s(live & conv), s(live & conv) + s(live & exit_)).alias("cv_rate"))


def channel_rates(edges: DataFrame) -> DataFrame:
    """Per channel: its share of terminal transitions that convert, that exit, and their ratio."""
    live = edges.filter(~F.col("from_state").isin(*TERMINAL))
    per = live.groupBy("from_state").agg(
        F.sum(F.when(F.col("to_state") == CONVERSION, F.col("cnt"))).alias("conv"),
        F.sum(F.when(F.col("to_state") == END, F.col("cnt"))).alias("exits")).na.fill(0)
    done = F.sum(F.col("conv") + F.col("exits")).over(W.partitionBy())
    return per.select(F.col("from_state").alias("channel"),
                      F.try_divide(F.col("conv"), done).alias("cv_rate"),
                      F.try_divide(F.col("exits"), done).alias("exit_rate"),
                      F.try_divide(F.col("conv"), F.col("exits")).alias("cv_exit_rate"))


def _channels(edges: DataFrame) -> DataFrame:
    return edges.filter(~F.col("from_state").isin(*FAKE)).select(F.col("from_state").alias("channel")).distinct()


def _share(df: DataFrame, value: str, name: str = "weight") -> DataFrame:
    return df.withColumn(name, F.try_divide(F.col(value), F.sum(value).over(W.partitionBy())))


def last_touch_matrix(edges: DataFrame) -> DataFrame:
    conv = (edges.filter(~F.col("from_state").isin(*FAKE)).groupBy(F.col("from_state").alias("channel"))
            .agg(F.coalesce(F.sum(F.when(F.col("to_state") == CONVERSION, F.col("cnt"))), F.lit(0)).alias("n")))
    return _share(conv, "n").select("channel", "weight")


def first_touch_matrix(edges: DataFrame) -> DataFrame:
    """Share of starts times share of conversions, normalised."""
    edges = settle(edges)
    starts = _share(edges.filter(F.col("from_state") == START)
                    .select(F.col("to_state").alias("channel"), "cnt"), "cnt", "start")
    convs = _share(edges.filter((F.col("to_state") == CONVERSION) & ~F.col("from_state").isin(*TERMINAL))
                   .select(F.col("from_state").alias("channel"), "cnt"), "cnt", "conv")
    both = (_channels(edges).join(starts, "channel", "left").join(convs, "channel", "left")
            .select("channel", F.coalesce(F.col("start") * F.col("conv"), F.lit(0.0)).alias("v")))
    return _share(both, "v").select("channel", "weight")


def _removals(edges: DataFrame, include_start: bool) -> tuple[DataFrame, DataFrame]:
    """The edges once per removed channel (``removed`` column), and the removed channels."""
    p = transition_probs(edges).select("from_state", "to_state", "p")
    skip = TERMINAL if include_start else FAKE
    names = (edges.filter(~F.col("from_state").isin(*skip))
             .agg(F.array_sort(F.collect_set("from_state")).alias("names")))
    keyed = p.withColumn("removed", F.explode(names.scalar()))
    removed = names.select(F.explode("names").alias("removed"))
    return keyed, removed


def removal_effect(edges: DataFrame, mode: str = "drop", n: int = 0, digits: int = 3,
                   cut_every: int = 4, tol: float = 1e-13, max_steps: int = 1_000_000) -> DataFrame:
    """What conversion loses when a channel disappears: ``channel, weight``.

    ``drop``: the channel's row and column go, without renormalising, and the (n+1)-step matrix is
    used; the change relative to the base rate. ``redirect``: the channel sends everyone to END;
    loss relative to the base rate, normalised. ``absorbing``: total conversion mass of the chain
    without the channel, normalised.
    """
    edges = settle(edges)
    if mode == "absorbing":
        return _absorbing(edges, tol, max_steps)
    keyed, removed, reach = _first_reach(edges, mode)
    for step in range(n):
        reach = _one_step_back(reach, keyed)
        if (step + 1) % cut_every == 0:
            reach = settle(reach)
    return _removal_weight(edges, removed, reach, mode, digits)


def _first_reach(edges: DataFrame, mode: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rewritten edges per removed channel, the removed channels, and one-step reach of the terminals."""
    keyed, removed = _removals(edges, include_start=mode == "drop")
    gone = F.col("removed")
    if mode == "drop":
        keyed = keyed.filter((F.col("from_state") != gone) & (F.col("to_state") != gone))
    elif mode == "redirect":
        to_end = removed.select(F.col("removed").alias("from_state"), F.lit(END).alias("to_state"),
                                F.lit(1.0).alias("p"), "removed")
        keyed = keyed.filter(F.col("from_state") != gone).unionByName(to_end)
    else:
        raise ValueError(f"unknown mode {mode}")
    reach = keyed.filter(F.col("to_state").isin(*TERMINAL)).select(
        "removed", F.col("to_state").alias("target"), F.col("from_state").alias("state"), F.col("p").alias("r"))
    return keyed, removed, reach


def _one_step_back(reach: DataFrame, keyed: DataFrame) -> DataFrame:
    return (reach.join(keyed.withColumnRenamed("to_state", "state"), ["removed", "state"])
            .groupBy("removed", "target", F.col("from_state").alias("state"))
            .agg(F.sum(F.col("r") * F.col("p")).alias("r")))


def _removal_weight(edges: DataFrame, removed: DataFrame, reach: DataFrame, mode: str, digits: int) -> DataFrame:
    if mode == "drop":
        reach = reach.filter(~F.col("state").isin(*TERMINAL))
    rate = conversion_rate(edges).select("cv_rate")
    s = lambda target: F.coalesce(F.sum(F.when(F.col("target") == target, F.col("r"))), F.lit(0.0))
    per = reach.groupBy(F.col("removed").alias("channel")).agg(
        F.try_divide(s(CONVERSION), s(CONVERSION) + s(END)).alias("rate"))
    # a channel whose removal leaves no edge into END or CONVERSION still gets a row
    per = removed.select(F.col("removed").alias("channel")).join(per, "channel", "left").na.fill(0.0, ["rate"])
    if mode == "drop":
        return per.select("channel", F.bround(F.try_divide(F.col("rate"), rate.scalar()) - 1, digits).alias("weight"))
    loss = per.select("channel", (1 - F.try_divide(F.col("rate"), rate.scalar())).alias("loss"))
    return _share(loss, "loss", "w").select("channel", F.bround("w", digits).alias("weight"))


def removal_sweep(edges: DataFrame, steps: int = 15, mode: str = "drop", digits: int = 3) -> DataFrame:
    """``removal_effect`` for 1..steps applications of the matrix: ``channel, step, weight``."""
    edges = settle(edges)
    keyed, removed, reach = _first_reach(edges, mode)
    keyed, out = settle(keyed), None
    for step in range(steps):
        # each power continues from the written result of the one before
        reach = settle(reach if step == 0 else _one_step_back(reach, keyed))
        part = _removal_weight(edges, removed, reach, mode, digits).withColumn("step", F.lit(step + 1))
        out = part if out is None else out.unionByName(part)
    return out.select("channel", "step", "weight")


def _reach_conversion(chain: DataFrame, keys: list[str], tol: float, max_steps: int) -> DataFrame:
    """Probability to ever reach CONVERSION from each state, per ``keys``.

    ``chain`` holds the transient edges and the edges into CONVERSION. Value iteration: the probability to arrive within
    n + 1 steps is that of the direct edge plus the edges' weighted probabilities within n. Each chain iterates
    in one task, which holds its edge list and one vector, until no value grows by ``tol``; slow chains take
    thousands of steps, so a step must not be a job. A chain's edges are those left after pruning (at most the square
    of 100 / pct channels). States that cannot reach CONVERSION have no row.
    """
    def iterate(pdf: pd.DataFrame) -> pd.DataFrame:
        states, code = np.unique(pdf["from_state"], return_inverse=True)
        to = pdf["to_state"].to_numpy()
        p = pdf["p"].to_numpy(np.float64)
        ends = to == CONVERSION
        direct = np.bincount(code[ends], p[ends], len(states))
        place = np.searchsorted(states, to[~ends])
        held = (place < len(states)) & (states[np.minimum(place, len(states) - 1)] == to[~ends])
        start, place, p = code[~ends][held], place[held], p[~ends][held]     # other targets have no way on
        v = direct
        for _ in range(max_steps):
            new = direct + np.bincount(start, p * v[place], len(states))
            grown, v = float((new - v).max()), new
            if grown < tol:
                break
        else:
            raise RuntimeError(f"a probability still grows by {grown} a step after {max_steps} steps")
        out = pd.DataFrame({k: pdf[k].iloc[:1].repeat(len(states)).to_numpy() for k in keys} | {"channel": states, "reach": v})
        return out[out["reach"] > 0]

    types = dict(chain.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "channel string, reach double"])
    return chain.select(*keys, "from_state", "to_state", "p").groupBy(*keys).applyInPandas(iterate, schema)


def _absorbing(edges: DataFrame, tol: float, max_steps: int) -> DataFrame:
    keyed, removed = _removals(edges, include_start=False)
    chain = keyed.filter((F.col("from_state") != F.col("removed")) & (F.col("to_state") != F.col("removed"))
                         & ~F.col("from_state").isin(*TERMINAL) & (F.col("to_state") != END))
    reach = _reach_conversion(chain, ["removed"], tol, max_steps)
    mass = reach.groupBy(F.col("removed").alias("channel")).agg(F.sum("reach").alias("mass"))
    full = removed.select(F.col("removed").alias("channel")).join(mass, "channel", "left").na.fill(0.0)
    return _share(full, "mass").select("channel", "weight")


def eventual_conversion(edges: DataFrame, digits: int = 3, tol: float = 1e-13,
                        max_steps: int = 1_000_000) -> DataFrame:
    """Probability to convert sooner or later from each channel, normalised over the channels."""
    edges = settle(edges)
    chain = (transition_probs(edges)
             .filter(~F.col("from_state").isin(*TERMINAL) & (F.col("to_state") != END)))
    reach = _reach_conversion(chain, [], tol, max_steps)
    full = _channels(edges).join(reach, "channel", "left").na.fill(0.0, ["reach"])
    return _share(full, "reach", "w").select("channel", F.bround("w", digits).alias("weight"))


def ppr_contribution(edges: DataFrame, alpha: float = 0.05, steps: int = 10, digits: int = 3) -> DataFrame:
    """Personalised-PageRank contribution of each state to conversion (only that row is computed)."""
    edges = settle(edges)
    m = settle(transition_probs(edges).select("from_state", F.col("to_state").alias("state"), "p"))
    # one row per edge target keeps the seed a function of the data
    seed = m.select(F.lit(CONVERSION).alias("state"), F.lit(1.0).alias("r")).distinct()
    r = seed
    for _ in range(steps):
        moved = m.join(r, "state").select(F.col("from_state").alias("state"), ((1 - alpha) * F.col("p") * F.col("r")).alias("r"))
        restart = seed.select("state", F.lit(alpha).alias("r"))
        r = moved.unionByName(restart).groupBy("state").agg(F.sum("r").alias("r"))
    real = _channels(edges).join(r.withColumnRenamed("state", "channel"), "channel", "left").na.fill(0.0, ["r"])
    return _share(real, "r", "w").select("channel", F.bround("w", digits).alias("weight"))


def visit_pass(edges: DataFrame, digits: int = 3, **kw) -> DataFrame:
    """``visit`` (one step from START) and ``pass_through`` = visit x eventual, normalised."""
    edges = settle(edges)
    visit = (transition_probs(edges).filter(F.col("from_state") == START)
             .select(F.col("to_state").alias("channel"), F.bround("p", digits).alias("visit")))
    both = (eventual_conversion(edges, digits, **kw).join(visit, "channel", "left").na.fill(0.0, ["visit"])
            .withColumn("v", F.col("visit") * F.col("weight")))
    return _share(both, "v", "w").select("channel", "visit", F.bround("w", digits).alias("pass_through"))
