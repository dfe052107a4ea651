"""Rule, weight and model based attribution over paths in long form (see ``path_touches``).

Every rule is one aggregation over touches: a path is never gathered to score it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.functions.ordered import lay_track, lift_off, quantiles, scan, spread
from visitloom.session import settle, store

PATH = ("gid", "conv_group")


def _normalise(df: DataFrame, value: str, name: str) -> DataFrame:
    """Share of the column total. There may be very many media, so the total is an aggregate of the
    settled scores and not a window that would bring all of them into one task."""
    df = settle(df)
    total = df.agg(F.sum(value).alias("t")).scalar()
    return df.withColumn(name, F.try_divide(F.col(value), total)).drop(*([value] if value != name else []))


def _score(touches: DataFrame, medium: str, weight, name: str, converting=None) -> DataFrame:
    """Weight per medium on converting paths, as a share; media of other paths get 0."""
    won = F.col("cv_marker") > 0 if converting is None else converting
    per = touches.groupBy(F.col(medium).alias("medium")).agg(
        F.coalesce(F.sum(F.when(won, weight)), F.lit(0.0)).alias("_w"))
    return _normalise(per, "_w", name)


def first_touch(touches: DataFrame, medium: str = "utm_hash") -> DataFrame:
    return _score(touches, medium, F.when(F.col("pos") == 1, 1.0).otherwise(0.0), "first_touch")


def last_touch(touches: DataFrame, medium: str = "utm_hash") -> DataFrame:
    return _score(touches, medium, F.when(F.col("pos") == F.col("n_touches"), 1.0).otherwise(0.0), "last_touch")


def position_based(touches: DataFrame, medium: str = "utm_hash", first: float = 0.6,
                   last: float = 0.2) -> DataFrame:
    """``first``/``last`` shares to the ends and the rest evenly between; two touches split evenly."""
    n = F.col("n_touches")
    weight = (F.when(n == 1, 1.0).when(n == 2, 0.5)
              .when(F.col("pos") == 1, first).when(F.col("pos") == n, last)
              .otherwise(F.lit(1 - first - last) / (n - 2)))
    return _score(touches, medium, weight, "position_based")


def linear_variant(touches: DataFrame, medium: str = "utm_hash") -> DataFrame:
    return position_based(touches, medium, first=0.4, last=0.4).withColumnRenamed("position_based", "linear")


def time_decay_weights(touches: DataFrame, lam: float, medium: str = "utm_hash", ts: str = "sess") -> DataFrame:
    """Weight table ``path keys, pos, n_touches, medium, w`` with w = exp(-lam * days to the last touch)."""
    days = (F.col("path_end") - F.col(ts)) / 86400.0
    return touches.select(*PATH, "pos", "n_touches", F.col(medium).alias("medium"),
                          F.exp(-F.lit(lam) * days).alias("w"))


def normalised_weights(weights: DataFrame) -> DataFrame:
    """Scale weights to sum to 1 within each path."""
    return (spread(weights, PATH, _sum=F.sum("w"))
            .withColumn("w", F.try_divide(F.col("w"), F.col("_sum"))).drop("_sum"))


def weighted_attribution(weights: DataFrame) -> DataFrame:
    """Share of normalised weight per medium, over all paths of the weight table."""
    per = normalised_weights(weights).groupBy("medium").agg(F.sum("w").alias("_w"))
    return _normalise(per, "_w", "norm_att")


def position_profile(weights: DataFrame) -> DataFrame:
    """How each medium's weight is distributed over positions (rows of a medium sum to 1)."""
    per = normalised_weights(weights).groupBy("medium", "pos").agg(F.sum("w").alias("w"))
    per = spread(per, ["medium"], medium_weight=F.sum("w"))
    return per.select("medium", "pos", F.try_divide(F.col("w"), F.col("medium_weight")).alias("share"), "medium_weight")


def touchpoint_curve(weights: DataFrame) -> DataFrame:
    """Normalised weight by path length and position: total, share within the length, and relative
    to the length's strongest position."""
    per = normalised_weights(weights).groupBy("n_touches", "pos").agg(F.sum("w").alias("weight"))
    per = spread(per, ["n_touches"], _sum=F.sum("weight"), _top=F.max("weight"))
    return per.select("n_touches", "pos", "weight", F.try_divide(F.col("weight"), F.col("_sum")).alias("share"),
                      F.try_divide(F.col("weight"), F.col("_top")).alias("relative"))


def utm_map(touches: DataFrame, utm: str = "utm_hash", tri: str = "trin") -> DataFrame:
    """Distinct (utm, trinomial) pairs with their number of touches and the utm's first trinomial."""
    pairs = touches.groupBy(F.col(utm).alias("utm_hash"), F.col(tri).alias("trinomial")).agg(
        F.count(F.lit(1)).alias("cnt"))
    firsts = pairs.groupBy("utm_hash").agg(F.min("trinomial").alias("first_trinomial"))
    return pairs.join(firsts, "utm_hash")


def rollup(scores: DataFrame, mapping: DataFrame, *values: str) -> DataFrame:
    """Sum utm scores over every utm seen with the trinomial."""
    m = mapping.select(F.col("utm_hash").alias("medium"), "trinomial")
    return m.join(scores, "medium").groupBy("trinomial").agg(*[F.sum(v).alias(v) for v in values])


def vocab_coverage(touches: DataFrame, medium: str = "utm_hash") -> DataFrame:
    """Media by frequency with share, cumulative share and rank."""
    counts = touches.groupBy(F.col(medium).alias("medium")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    laid, track = lay_track(counts, [], ["n", "medium"], descending=["n"])
    ranked = scan(laid, track, rank=("row_number", None), upto=("running_sum", "n"))
    t = total.scalar()
    return lift_off(ranked).select("medium", "n", "rank", (F.col("n") / t).alias("ratio"),
                                   (F.col("upto") / t).alias("cum_ratio"))


def lost_paths(touches: DataFrame, coverage: DataFrame, vocab_size: int, medium: str = "utm_hash") -> DataFrame:
    """Share of paths none of whose media are within the ``vocab_size`` most frequent."""
    known = coverage.filter(F.col("rank") <= vocab_size).select(F.col("medium").alias("_known"))
    per = (touches.join(known, touches[medium] == known["_known"], "left")
           .groupBy(*PATH).agg(F.max(F.col("_known").isNotNull()).alias("seen")))
    return per.agg(F.count(F.lit(1)).alias("paths"), F.count_if(~F.col("seen")).alias("lost"),
                   F.try_divide(F.count_if(~F.col("seen")), F.count(F.lit(1))).alias("lost_share"))


def compare_runs(runs: dict[str, DataFrame], value: str, key: str = "medium") -> DataFrame:
    """One column per run aligned on the key, missing scores 0, and their total."""
    parts = [df.select(key, F.lit(name).alias("_run"), F.col(value).alias("_v")) for name, df in runs.items()]
    long = reduce(DataFrame.unionByName, parts)
    wide = long.groupBy(key).pivot("_run", list(runs)).agg(F.sum("_v")).na.fill(0.0)
    return wide.withColumn("total", reduce(lambda a, b: a + b, [F.col(n) for n in runs]))


def average_without_suffix(scores: DataFrame, suffix: str, *values: str, key: str = "medium") -> DataFrame:
    """Strip a name suffix and average what then falls together."""
    return (scores.groupBy(F.regexp_replace(key, f"{suffix}$", "").alias(key))
            .agg(*[F.avg(v).alias(v) for v in values]))


def compare_positions(runs: dict[str, tuple[DataFrame, DataFrame]], score: str, positions: int = 3) -> DataFrame:
    """Position shares of several runs side by side, with the runs' total score per medium.

    ``runs`` maps a name to (position profile, scores); missing values are 0.
    """
    long = reduce(DataFrame.unionByName, [
        prof.filter(F.col("pos") <= positions).select(
            "medium", F.concat(F.lit("p"), F.col("pos").cast("string"), F.lit(f"_{name}")).alias("_c"), F.col("share").alias("_v"))
        for name, (prof, _) in runs.items()])
    totals = reduce(DataFrame.unionByName, [
        s.select("medium", F.lit("weight_sum").alias("_c"), F.col(score).alias("_v")) for _, s in runs.values()])
    cols = [*[f"p{i}_{n}" for n in runs for i in range(1, positions + 1)], "weight_sum"]
    return long.unionByName(totals).groupBy("medium").pivot("_c", cols).agg(F.sum("_v")).na.fill(0.0)


def group_difference(effect: DataFrame, group: str, a, b, values, key: str = "trinomial", n: str = "n_occ") -> DataFrame:
    """(x_a - x_b f)/(x_a + x_b f) with f = n_a/n_b per key, for keys present in both groups."""
    pick = lambda c, g: F.sum(F.when(F.col(group) == g, F.col(c)))
    per = effect.groupBy(key).agg(pick(n, a).alias("_na"), pick(n, b).alias("_nb"),
                                  *[pick(v, g).alias(f"_{v}_{s}") for v in values for g, s in ((a, "a"), (b, "b"))])
    f = F.try_divide(F.col("_na"), F.col("_nb"))
    diff = lambda v: F.try_divide(F.col(f"_{v}_a") - F.col(f"_{v}_b") * f, F.col(f"_{v}_a") + F.col(f"_{v}_b") * f)
    return per.filter(F.col("_na").isNotNull() & F.col("_nb").isNotNull()).select(key, *[diff(v).alias(f"dif_{v}") for v in values])


def class_token_share(touches: DataFrame, medium: str = "medium") -> DataFrame:
    """Share of each token among the touches of converting and of other paths."""
    c = lambda v: F.count_if(F.col("cv_marker") == v)
    per = touches.groupBy(F.col(medium).alias("medium")).agg(c(1).alias("_y"), c(0).alias("_n"))
    return _normalise(_normalise(per, "_y", "share_converted"), "_n", "share_other")


def model_removal_effect(paths: DataFrame, model, min_occ: int = 20, by=(), tokens: str = "utm_hash",
                         label: str = "label", score=None) -> DataFrame:
    """Median change of the model score on converting paths when a medium is masked out.

    Each path is scored once, and rescored once per distinct medium it contains. ``model`` is any fitted
    pipeline over the token array; ``score`` extracts the probability column from its output.
    """
    by = list(by)
    counts = (paths.select(F.explode(tokens).alias("medium")).groupBy("medium")
              .agg(F.count(F.lit(1)).alias("_occ")).filter(F.col("_occ") > min_occ))
    scored = model.transform(paths).select(*by, label, tokens, score.alias("_orig"))
    masked = (scored.withColumn("medium", F.explode(F.array_distinct(tokens)))
              .join(counts.select("medium"), "medium", "left_semi"))
    keep = masked.select(*by, "medium", label, "_orig", F.array_remove(F.col(tokens), F.col("medium")).alias(tokens))
    rescored = model.transform(keep).withColumn("_masked", score)
    n_occ = rescored.groupBy("medium", *by).agg(F.count(F.lit(1)).alias("n_occ"))
    won = rescored.filter(F.col(label) == 1)
    med = lambda c: quantiles(won, c, [0.5], ["medium", *by]).withColumnRenamed("q0", f"med{c}")
    effect = (n_occ.join(med("_orig"), ["medium", *by], "left").join(med("_masked"), ["medium", *by], "left")
              .withColumn("rm_eff", F.try_divide(F.col("med_masked") - F.col("med_orig"), F.col("med_orig"))))
    return effect.select("medium", *by, "n_occ", "rm_eff", (F.col("n_occ") * F.col("rm_eff")).alias("scaled_rm_eff"))


def rate_removal_effect(touches: DataFrame, min_occ: int = 20, by=(), medium: str = "utm_hash") -> DataFrame:
    """Median change of a path's score when a medium is masked out, without a fitted model.

    A path scores the mean conversion rate of its touches' media; a path of which nothing is left scores the rate of all
    touches. ``touches`` are path rows; ``by`` must be constant in a path. Media with at most ``min_occ`` touches are
    not masked. Works on one row per path and medium, never on a path as an array.
    """
    by = list(by)
    won = F.col("cv_marker") > 0
    per = touches.groupBy(*PATH, *by, F.col(medium).alias("medium")).agg(F.count(F.lit(1)).alias("_k"), F.max(won).alias("_won"))
    per = store(per)
    rates = per.groupBy("medium").agg(F.sum("_k").alias("_occ"), (F.sum(F.when(F.col("_won"), F.col("_k")).otherwise(0)) / F.sum("_k")).alias("_rate"))
    base = per.agg(F.try_divide(F.sum(F.when(F.col("_won"), F.col("_k")).otherwise(0)), F.sum("_k")).alias("b"))
    scored = per.join(rates, per["medium"].eqNullSafe(rates["medium"])).drop(rates["medium"])
    scored = spread(scored, [*PATH, *by], sized_by=per, _n=F.sum("_k"), _s=F.sum(F.col("_k") * F.col("_rate")))
    left = F.col("_n") - F.col("_k")
    scored = scored.filter(F.col("_occ") > min_occ).select(
        "medium", *by, "_won", (F.col("_s") / F.col("_n")).alias("_orig"),
        F.when(left > 0, (F.col("_s") - F.col("_k") * F.col("_rate")) / left).otherwise(base.scalar()).alias("_masked"))
    scored = store(scored)
    n_occ = scored.groupBy("medium", *by).agg(F.count(F.lit(1)).alias("n_occ"))
    med = lambda c: quantiles(scored.filter("_won"), c, [0.5], ["medium", *by]).withColumnRenamed("q0", f"med{c}")
    effect = (n_occ.join(med("_orig"), ["medium", *by], "left").join(med("_masked"), ["medium", *by], "left")
              .withColumn("rm_eff", F.try_divide(F.col("med_masked") - F.col("med_orig"), F.col("med_orig"))))
    return effect.select("medium", *by, "n_occ", "rm_eff", (F.col("n_occ") * F.col("rm_eff")).alias("scaled_rm_eff"))


def removal_rollup(effect: DataFrame, mapping: DataFrame, min_occ: int = 20, by=()) -> DataFrame:
    """Model removal effects summed by the first trinomial of each utm (and ``by``), rarely seen media left out."""
    tri = mapping.select(F.col("utm_hash").alias("medium"), F.col("first_trinomial").alias("trinomial")).distinct()
    return (effect.filter(F.col("rm_eff").isNotNull() & (F.col("n_occ") > min_occ)).join(tri, "medium")
            .groupBy("trinomial", *by).agg(F.sum("n_occ").alias("n_occ_sum"), F.count("n_occ").alias("n_occ_count"),
                                      F.sum("rm_eff").alias("rm_eff"), F.sum("scaled_rm_eff").alias("scaled_rm_eff"))
            .withColumn("m_rm_eff", F.col("rm_eff") / F.col("n_occ_count")))
