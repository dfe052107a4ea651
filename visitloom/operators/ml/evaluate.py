"""Evaluation of scored tables. Scores are reduced to counts per distinct value before any ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.functions.ordered import ALL, lay_track, lift_off, quantiles, scan
from visitloom.session import store


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class; a class never predicted has precision 0."""
    c = confusion(df, label, pred)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n"))
    rows = c.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    cols = c.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("predicted"))
    j = rows.join(cols, "class", "full").na.fill(0, ["support", "tp", "predicted"])
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    return j.select("class", p.alias("precision"), r.alias("recall"),
                    F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def binary_rates(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Accuracy, precision, true positive and true negative rate in one row."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    tp, tn = F.count_if(y & p), F.count_if(~y & ~p)
    fp, fn = F.count_if(~y & p), F.count_if(y & ~p)
    return df.agg(tp.alias("tp"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"),
                  F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"),
                  F.try_divide(tp, tp + fp).alias("precision"),
                  F.try_divide(tp, tp + fn).alias("tpr"), F.try_divide(tn, tn + fp).alias("tnr"))


def _score_counts(df: DataFrame, label: str, score: str, by) -> DataFrame:
    return df.groupBy(*by, F.col(score).alias("_s")).agg(
        F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("_neg"))


def auc(df: DataFrame, label: str = "label", score: str = "score", by=()) -> DataFrame:
    """Area under the ROC curve by rank sums, ties counted half."""
    keys = list(by) or [ALL]
    base = df if by else df.withColumn(ALL, F.lit(0))
    counts = _score_counts(base, label, score, keys)
    laid, track = lay_track(counts, keys, ["_s"])
    below = lift_off(scan(laid, track, _below=("prior_sum", "_neg")))
    out = below.groupBy(*keys).agg(
        F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2)).alias("_u"),
        F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"))
    return out.select(*by, "positives", "negatives",
                      F.try_divide(F.col("_u"), F.col("positives") * F.col("negatives")).alias("auc"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """False and true positive rate at every distinct score."""
    counts = _score_counts(df, label, score, [])
    laid, track = lay_track(counts, [], ["_s"], descending=["_s"])
    cum = lift_off(scan(laid, track, _tp=("running_sum", "_pos"), _fp=("running_sum", "_neg")))
    tot = counts.agg(F.struct(F.sum("_pos").alias("p"), F.sum("_neg").alias("n")).alias("t")).scalar()
    return cum.select(F.col("_s").alias("threshold"),
                      F.try_divide(F.col("_fp"), tot["n"]).alias("fpr"),
                      F.try_divide(F.col("_tp"), tot["p"]).alias("tpr"))


def multiclass_auc(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """One-vs-rest AUC per class plus their mean (``macro``) and the pooled one (``micro``)."""
    pairs = ", ".join(f"'{cls}', cast(`{c}` as double)" for cls, c in scores.items())
    long = df.select(F.col(label).cast("string").alias("_y"), F.expr(f"stack({len(scores)}, {pairs}) as (class, score)"))
    long = long.withColumn("label", (F.col("_y") == F.col("class")).cast("int"))
    each = auc(long, by=["class"]).select("class", "auc")
    macro = each.agg(F.lit("macro").alias("class"), F.avg("auc").alias("auc"))
    micro = auc(long).select(F.lit("micro").alias("class"), "auc")
    return each.unionByName(macro).unionByName(micro)


def threshold_sweep(df: DataFrame, label: str = "label", score: str = "score", n: int = 100) -> DataFrame:
    """Precision, recall and F1 at ``n`` thresholds from the lowest score to 0.999 of the highest.

    Scores fall into the n buckets between thresholds; running sums over the buckets, from the top,
    give every threshold at once.
    """
    edges = df.agg(F.struct(F.min(score).alias("lo"), (F.max(score) * 0.999).alias("hi")).alias("e")).scalar()
    lo, hi = edges["lo"], edges["hi"]
    step = (hi - lo) / (n - 1)
    # highest threshold index not above the score; corrected for the division's rounding
    k = F.floor(F.try_divide(F.col(score) - lo, step))
    k = F.when(lo + (k + 1) * step <= F.col(score), k + 1).when(lo + k * step > F.col(score), k - 1).otherwise(k)
    k = F.least(F.greatest(k, F.lit(0)), F.lit(n - 1))
    hist = (df.groupBy(F.coalesce(k, F.lit(0)).alias("k"))
            .agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")))
    every = df.sparkSession.range(n).select(F.col("id").alias("k"))
    full = every.join(hist, "k", "left").na.fill(0)
    up = W.orderBy(F.col("k").desc())
    whole = W.partitionBy()
    tp, chosen, all_pos = F.sum("pos").over(up), F.sum("n").over(up), F.sum("pos").over(whole)
    p, r = F.coalesce(F.try_divide(tp, chosen), F.lit(0.0)), F.coalesce(F.try_divide(tp, all_pos), F.lit(0.0))
    return full.select("k", (lo + F.col("k") * step).alias("threshold"), p.alias("precision"), r.alias("recall"),
                       F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def best_f1(sweep: DataFrame) -> DataFrame:
    """The sweep row with the highest F1, the lowest threshold among equals."""
    return sweep.orderBy(F.col("f1").desc(), "threshold").limit(1)


def calibration_bins(df: DataFrame, label: str = "label", score: str = "score", bins: int = 10) -> DataFrame:
    """Share of positives per right-closed score bin."""
    b = F.ceil(F.round(F.col(score) * bins, 9)).cast("int")
    return (df.filter((F.col(score) > 0) & (F.col(score) <= 1)).groupBy(b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("fraction")))


def hazard_scores(df: DataFrame, scores: list[str]) -> DataFrame:
    """Score of each period given that no earlier one happened: s_k / sum of s_j, j >= k."""
    cols = {}
    for i, c in enumerate(scores):
        rest = sum((F.col(x) for x in scores[i + 1:]), F.col(c))
        cols[f"{c}_hazard"] = F.try_divide(F.col(c), rest)
    return df.withColumns(cols)


def gain_curve(df: DataFrame, truth: str, rank_by: str, id_col: str) -> DataFrame:
    """Cumulative share of truth when rows are taken from the highest ``rank_by`` down."""
    base = df.select(F.col(id_col).alias("_id"), F.col(truth).alias("_y"), F.col(rank_by).alias("_s"))
    total = base.agg(F.struct(F.sum("_y").cast("double").alias("t"), F.count(F.lit(1)).alias("n")).alias("x")).scalar()
    laid, track = lay_track(base, [], ["_s", "_id"], descending=["_s"])
    cum = lift_off(scan(laid, track, _cum=("running_sum", "_y"), _rn=("row_number", None)))
    return cum.select(F.col("_id").alias(id_col), (F.col("_rn") / total["n"]).alias("cum_customers"),
                      F.try_divide(F.col("_cum").cast("double"), total["t"]).alias("gain"))


def gain_gini(df: DataFrame, truth: str, pred: str, base: str, id_col: str) -> DataFrame:
    """Gini of the perfect, baseline and model order: raw = 2 mean(gain) - 1, and relative to perfect."""
    raw = lambda c, name: gain_curve(df, truth, c, id_col).agg(
        F.lit(name).alias("curve"), (2 * F.avg("gain") - 1).alias("raw"))
    rows = raw(truth, "lorenz").unionByName(raw(base, "baseline")).unionByName(raw(pred, "model"))
    best = F.max(F.when(F.col("curve") == "lorenz", F.col("raw"))).over(W.partitionBy())
    return rows.withColumn("normalized", F.try_divide(F.col("raw"), best))


def quantile_bins(df: DataFrame, c: str, q: int, out: str = "bin") -> DataFrame:
    """Equal-frequency bins with interpolated, right-closed edges; a value on an edge goes below."""
    edges = quantiles(df, c, [i / q for i in range(1, q)])
    edge = edges.select(F.struct(*[f"q{i}" for i in range(q - 1)]).alias("e")).scalar()
    above = F.lit(0)
    for i in range(q - 1):
        above = above + F.when(F.col(c).cast("double") > edge[f"q{i}"], 1).otherwise(0)
    return df.withColumn(out, F.when(F.col(c).isNotNull(), above))


def decile_stats(df: DataFrame, truth: str, pred: str, q: int = 10) -> DataFrame:
    """Means, normalised RMSE and MAE, and relative error per prediction decile."""
    y, p = F.col(truth).cast("double"), F.col(pred).cast("double")
    m = F.avg(y)
    return (quantile_bins(df, pred, q, "decile").groupBy("decile").agg(
        m.alias("label_mean"), F.avg(p).alias("pred_mean"),
        F.try_divide(F.sqrt(F.avg((y - p) ** 2)), m).alias("normalized_rmse"),
        F.try_divide(F.avg(F.abs(y - p)), m).alias("normalized_mae"))
        .withColumn("decile_mape", F.try_divide(F.abs(F.col("pred_mean") - F.col("label_mean")), F.col("label_mean"))))


def mutual_info(df: DataFrame, score: str, label: str, bins: int = 20) -> DataFrame:
    """Mutual information of an equal-width-binned score and a label, and sqrt(1 - exp(-2 MI)).

    Counts per (bin, label) first, so the marginal windows see a fixed number of rows.
    """
    edges = df.agg(F.struct(F.min(score).cast("double").alias("lo"), F.max(score).cast("double").alias("hi")).alias("e")).scalar()
    lo, hi = edges["lo"], edges["hi"]
    b = F.coalesce(F.least(F.floor(F.try_divide(F.col(score) - lo, hi - lo) * bins), F.lit(bins - 1)), F.lit(0))
    cells = df.groupBy(b.alias("_b"), F.col(label).alias("_y")).agg(F.count(F.lit(1)).alias("_n"))
    n = F.sum("_n").over(W.partitionBy())
    pb, py = F.sum("_n").over(W.partitionBy("_b")), F.sum("_n").over(W.partitionBy("_y"))
    terms = cells.select((F.col("_n") / n * F.ln(F.col("_n") * n / (pb * py))).alias("t"))
    mi = F.greatest(F.sum("t"), F.lit(0.0))
    return terms.agg(mi.alias("mi")).withColumn("total_correlation", F.sqrt(1 - F.exp(-2 * F.col("mi"))))


def _digamma(m):
    """Of whole numbers from 1 on: the recurrence up to m + 6 and four terms of the asymptotic series there."""
    m = m.cast("double")
    x = m + 6
    steps = sum(((F.lit(1.0) / (m + j)) for j in range(1, 6)), F.lit(1.0) / m)
    return F.ln(x) - 1 / (2 * x) - 1 / (12 * x ** 2) + 1 / (120 * x ** 4) - 1 / (252 * x ** 6) - steps


def nearest_mutual_info(df: DataFrame, features, label: str, id_col: str, k: int = 3, min_rows: int | None = None) -> DataFrame:
    """Nearest-neighbour mutual information of each numeric feature and a class: feature, mi, total_correlation.

    A row's radius is the distance to its k-th nearest row of the same class (fewer in smaller classes; classes of one
    row are left out), and the rows of all classes nearer than that are counted, itself included; at radius 0 its
    ties are. With one sorted dimension the neighbours are among k rows on either side, which lags and leads reach,
    and the counts are running sums over rows and radius ends in one order. Both are ordered scans that split
    large classes and features; no pairs are built. Negative estimates are 0. Null features are left out.
    """
    entries = F.array(*[F.struct(F.lit(f).alias("_f"), F.col(f).cast("double").alias("_x")) for f in features])
    long = df.select(F.col(id_col).alias("_id"), F.col(label).alias("_y"), F.explode(entries).alias("_e")).select("_id", "_y", "_e.*")
    long = store(long.filter("_x IS NOT NULL AND NOT isnan(_x) AND _y IS NOT NULL"))
    sizes = long.groupBy("_f", "_y").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    laid, track = lay_track(store(long.join(sizes, ["_f", "_y"])), ["_f", "_y"], ["_x", "_id"], min_rows=min_rows)
    before = after = "_x"
    sides = []
    for j in range(1, k + 1):
        laid = scan(laid, track, **{f"_b{j}": ("lag", before), f"_a{j}": ("lead", after)})
        before, after = f"_b{j}", f"_a{j}"
        sides += [before, after]
    near = lift_off(laid).withColumn("_k", F.least(F.lit(k), F.col("_size") - 1).cast("int"))
    distances = F.array_sort(F.filter(F.array(*[F.abs(F.col(c) - F.col("_x")) for c in sides]), lambda d: d.isNotNull()))
    near = store(near.withColumn("_r", F.element_at(distances, F.col("_k"))).select("_f", "_id", "_x", "_r", "_k", "_size"))
    # radius ends: open, so the lower one counts rows up to it and the upper one rows below it; closed at radius 0
    ends = near.select("_f", "_id", "_x", F.explode(F.array(
        F.struct((F.col("_x") - F.col("_r")).alias("_v"), F.when(F.col("_r") > 0, 2).otherwise(0).alias("_kind"), F.lit(-1).alias("_sign")),
        F.struct((F.col("_x") + F.col("_r")).alias("_v"), F.when(F.col("_r") > 0, 0).otherwise(2).alias("_kind"), F.lit(1).alias("_sign")))).alias("_e"))
    ends = ends.select("_f", "_id", "_e.*", F.lit(0).alias("_n"))
    points = near.select("_f", "_id", F.col("_x").alias("_v"), F.lit(1).alias("_kind"), F.lit(0).alias("_sign"), F.lit(1).alias("_n"))
    laid, track = lay_track(store(points.unionByName(ends)), ["_f"], ["_v", "_kind", "_id", "_sign"], min_rows=min_rows)
    inside = lift_off(scan(laid, track, _below=("prior_sum", "_n"))).filter("_n = 0").groupBy("_f", "_id").agg(F.sum(F.col("_sign") * F.col("_below")).alias("_m"))
    both = near.join(inside, ["_f", "_id"])
    mi = _digamma(F.count(F.lit(1))) + F.avg(_digamma(F.col("_k")) - _digamma(F.col("_size")) - _digamma(F.col("_m")))
    out = both.groupBy(F.col("_f").alias("feature")).agg(F.greatest(mi, F.lit(0.0)).alias("mi"))
    return out.withColumn("total_correlation", F.sqrt(1 - F.exp(-2 * F.col("mi"))))
