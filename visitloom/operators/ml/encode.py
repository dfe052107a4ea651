"""Feature encodings learned from a training table and applied by join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.functions.ordered import ALL, lay_track, lift_off, scan, split_rank


def target_encode(train: DataFrame, df: DataFrame, cols, label: str, smoothing: float = 10.0,
                  min_leaf: int = 10) -> DataFrame:
    """Category mean shrunk to the overall mean by a sigmoid of the category count.

    A category seen once, or never, gets the overall mean.
    """
    prior = train.agg(F.avg(label).alias("m"))
    out = df
    for c in cols:
        m = prior.scalar()
        stats = train.groupBy(F.col(c).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.avg(label).alias("_m"))
        pull = 1 / (1 + F.exp(-(F.col("_n") - min_leaf) / smoothing))
        enc = stats.select("_k", F.when(F.col("_n") == 1, m).otherwise(m * (1 - pull) + F.col("_m") * pull)
                           .alias(f"{c}_te"))
        out = (out.join(enc, out[c].eqNullSafe(enc["_k"]), "left").drop("_k")
               .withColumn(f"{c}_te", F.coalesce(F.col(f"{c}_te"), prior.scalar())))
    return out


def pseudo_encode(train: DataFrame, df: DataFrame, cols, label: str, k: float) -> DataFrame:
    """Posterior rate with ``k`` pseudo-counts and its confidence ln((1+n)/k)."""
    prior = train.agg(F.avg(label).alias("m"))
    out = df
    for c in cols:
        n, pos = F.count(label), F.sum(label)
        enc = train.groupBy(F.col(c).alias("_k")).agg(n.alias("_n"), pos.alias("_p")).select(
            "_k", ((F.col("_p") + k * prior.scalar()) / (F.col("_n") + k)).alias(f"avg_rate_{c}"),
            F.ln((1 + F.col("_n")) / F.lit(float(k))).alias(f"confidence_{c}"))
        out = out.join(enc, out[c] == enc["_k"], "left").drop("_k")
    return out


def quantile_transform(train: DataFrame, df: DataFrame, c: str, out: str | None = None) -> DataFrame:
    """Map a value to its rank share in the training data, interpolating between known values.

    Training values and the rows to map are merged in one ordered scan, so neither side is
    collected or broadcast.
    """
    name = out or f"{c}_q"
    counts = train.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("t"))
    laid, track = lay_track(counts, [], ["_v"])
    ranked = lift_off(scan(laid, track, _to=("running_sum", "_n")))
    # mean rank of equal values, from 0 to 1
    known = ranked.select("_v", F.coalesce(F.try_divide(F.col("_to") - (F.col("_n") + 1) / 2, total.scalar() - 1), F.lit(0.0)).alias("_q"))
    asked = df.filter(F.col(c).isNotNull()).select(F.col(c).cast("double").alias("_v")).distinct()
    merged = asked.join(known, "_v", "full")
    laid, track = lay_track(merged, [], ["_v"])
    point = F.when(F.col("_q").isNotNull(), F.struct("_v", "_q"))
    near = lift_off(scan(laid, track, _lo=("last_known", point), _hi=("next_known", point)))
    lo, hi = F.col("_lo"), F.col("_hi")
    q = (F.when(lo.isNull(), 0.0).when(hi.isNull(), 1.0).when(lo["_v"] == hi["_v"], lo["_q"])
         .otherwise(lo["_q"] + (hi["_q"] - lo["_q"]) * (F.col("_v") - lo["_v"]) / (hi["_v"] - lo["_v"])))
    table = near.select(F.col("_v").alias("_key"), q.alias(name))
    return df.join(table, F.col(c).cast("double") == F.col("_key"), "left").drop("_key")


def standardise(train: DataFrame, df: DataFrame, cols) -> DataFrame:
    """(x - mean) / population deviation of the training data."""
    stats = train.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols])
    out = {}
    for c in cols:
        st = stats.select(c).scalar()
        out[f"{c}_z"] = F.try_divide(F.col(c) - st["m"], st["s"])
    return df.withColumns(out)


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Row weight (1/n_class) * N/2."""
    sizes = df.groupBy(F.col(label).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    weights = sizes.select("_c", (F.sum("_n").over(W.partitionBy()) / 2.0 / F.col("_n")).alias(out))
    return df.join(weights, F.col(label) == F.col("_c")).drop("_c")


def downsample(df: DataFrame, label: str, id_col: str) -> DataFrame:
    """As many rows of each class as the smallest class has, the first by a hash of the id."""
    ranked = split_rank(df.withColumn("_h", F.md5(F.col(id_col).cast("string"))), [label], ["_h", id_col], name="_rn").drop("_h")
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("m"))
    return ranked.filter(F.col("_rn") <= least.scalar()).drop("_rn")


def frequent_tokens(df: DataFrame, tokens: str, top_n: int, pad_to: int | None, id_col: str) -> DataFrame:
    """Token arrays as frequency ranks (1 = most frequent), rare tokens dropped, padded with 0.

    ``pad_to`` is a model's number of inputs; None keeps every array at its own length.
    """
    long = df.select(id_col, F.posexplode(tokens).alias("_pos", "_t"))
    counts = long.groupBy("_t").agg(F.count(F.lit(1)).alias("_n"))
    vocab = split_rank(counts, [], ["_n", "_t"], descending=["_n"]).filter(F.col("rn") <= top_n).select("_t", "rn")
    rows = long.join(vocab, "_t").groupBy(id_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "rn"))), lambda x: x["rn"]).alias("_ids"))
    if pad_to is None:
        return df.select(id_col).join(rows, id_col, "left").select(id_col, F.coalesce("_ids", F.array().cast("array<bigint>")).alias("token_ids"))
    zeros = F.array_repeat(F.lit(0).cast("long"), pad_to)
    return (df.select(id_col).join(rows, id_col, "left")
            .select(id_col, F.slice(F.concat(F.coalesce("_ids", F.array().cast("array<bigint>")), zeros), 1, pad_to)
                    .alias("token_ids")))
