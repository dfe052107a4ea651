"""Mix sources to target word counts with Pareto order sampling (DataFrame functions only).

Each source gets a target by weight. Inside a source a document's expected copies are
``min(cap, lambda * importance)``, with lambda such that the expected words meet the target. The whole
part is taken as certain copies. The fraction p is an inclusion probability: documents are ranked by
``(u / (1 - u)) / (p / (1 - p))`` with a random u from their id, and the head of the ranking is taken
whose words come nearest to what the target leaves: a sample of fixed size, the size being words.

Defined cases: a null or blank text has size 0 and takes 0 words. Null is a source of its own, the last.
Repeated rows count as often as they occur; equal ids share a random number and are ordered by size.
An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.functions.ordered import lay_track, lift_off, scan
from visitloom.llm.common import uniform
from visitloom.session import store

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_CELL = 100            # of the ranking; cells bound what one window task sorts
MAX_CELLS = 65536              # per source


def length_importance(size: Column) -> Column:
    """Longer documents are likelier, by the logarithm of their words."""
    return F.log(size + F.lit(2.718281828459045))


def source_targets(sizes: DataFrame, share: float, cap: float, weights=(5, 2, 1)) -> DataFrame:
    """(source, source_size) to targets: weights cycle by code point, none above ``cap`` times its size.

    Sources fill up in the order of cap / weight. One is full if, with all before it full, its share of
    the rest reaches its cap; this is the fixed point of resharing the excess by weight.
    """
    laid, track = lay_track(sizes, [], ["source"])
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = lift_off(scan(laid, track, _rn=("row_number", None))).withColumn("_w", cycle)
    ranked = ranked.withColumn("_cap", F.col("source_size") * float(cap)).withColumn("_fill", F.col("_cap") / F.col("_w"))
    ranked = store(ranked)
    all_size, all_w = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    total, all_w = float(all_size or 0) * share, float(all_w or 0)
    laid, track = lay_track(ranked, [], ["_fill", "_rn"])
    filled = lift_off(scan(laid, track, _cap0=("prior_sum", "_cap"), _w0=("prior_sum", "_w")))
    full = F.col("_cap") * (F.lit(all_w) - F.col("_w0")) <= F.col("_w") * (F.lit(total) - F.col("_cap0"))
    filled = store(filled.withColumn("_full", full))
    used, used_w = filled.filter("_full").agg(F.sum("_cap"), F.sum("_w")).first()
    left_w = all_w - float(used_w or 0)
    level = (total - float(used or 0)) / left_w if left_w > 0 else 0.0
    return filled.select("source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * level).alias("target"))


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights=(5, 2, 1), importance=length_importance,
        seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    ``importance`` maps the size column to a positive weight, used to two decimals, so that a source
    has a bounded number of distinct weights and lambda is solved on (source, weight) sums.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    base = docs.select("doc_id", "source", size.alias("size"))
    base = store(base.withColumn("_v", F.greatest(F.round(importance(F.col("size")) * 100), F.lit(1.0)).cast("long")))
    rows = base.count()

    classes = base.groupBy("source", "_v").agg(F.sum("size").alias("_s"))
    targets = source_targets(classes.groupBy("source").agg(F.sum("_s").alias("source_size")), share, cap, weights)

    # lambda: weights from the largest down are capped while the rest's share would pass the cap
    by = W.partitionBy("source").orderBy(F.desc("_v")).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    c = classes.join(targets.withColumnRenamed("source", "_src"), F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    c = c.withColumn("_vs", F.col("_v") * F.col("_s"))
    c = c.withColumns({"_s0": F.coalesce(F.sum("_s").over(by), zero), "_vs0": F.coalesce(F.sum("_vs").over(by), zero),
                       "_vs_all": F.sum("_vs").over(W.partitionBy("source"))})
    capped = F.col("_v") * (F.col("target") - cap * F.col("_s0")) >= cap * (F.col("_vs_all") - F.col("_vs0"))
    c = c.withColumn("_capped", capped)
    rest = F.sum(F.when(~F.col("_capped"), F.col("_vs")))
    plan = c.groupBy("source").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"),
        ((F.first("target") - cap * F.coalesce(F.sum(F.when(F.col("_capped"), F.col("_s"))), zero)) / F.when(rest > 0, rest)).alias("_lambda"))
    plan = store(plan.withColumnRenamed("source", "_src"))

    d = base.join(plan, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    d = d.withColumn("_e", F.coalesce(F.least(F.lit(float(cap)), F.col("_lambda") * F.col("_v")), F.lit(float(cap))))
    d = d.withColumn("copies", F.floor(F.col("_e") + 1e-9)).withColumn("_p", F.greatest(F.col("_e") - F.col("copies"), F.lit(0.0)))
    u = uniform(F.col("doc_id"), seed)
    d = d.withColumn("_u", u).withColumn("_q", F.when(F.col("_p") > 1e-9, (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))))
    cells = max(16, min(MAX_CELLS, rows // ROWS_PER_CELL))
    d = store(d.withColumn("_cell", F.floor(F.col("_q") / (1 + F.col("_q")) * cells)).drop("_v", "_u", "_e", "_lambda", "_p"))

    # what the certain copies leave of the target, and the ranked words before each cell
    certain = F.sum(F.col("copies") * F.col("size"))
    sums = d.groupBy("source", "_cell").agg(F.sum("size").alias("_words"), certain.alias("_certain"))
    before = W.partitionBy("source").orderBy(F.col("_cell").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    cell = sums.select(F.col("source").alias("_src"), F.col("_cell").alias("_c"), F.sum("_certain").over(W.partitionBy("source")).alias("_sure"),
                       F.coalesce(F.sum("_words").over(before), zero).alias("_ahead"))
    inside = W.partitionBy("source", "_cell").orderBy("_q", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ranked = d.filter("_cell IS NOT NULL").withColumn("_before", F.coalesce(F.sum("size").over(inside), zero))
    ranked = ranked.join(cell, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_cell") == F.col("_c")))
    chosen = F.col("_ahead") + F.col("_before") + F.col("size") / 2 <= F.col("target") - F.col("_sure")
    ranked = ranked.withColumn("copies", F.col("copies") + F.when(chosen, 1).otherwise(0))
    out = ["doc_id", "source", "size", "source_size", "target", F.col("copies").cast("long").alias("copies"),
           (F.col("copies") * F.col("size")).cast("long").alias("taken")]
    return ranked.select(*out).unionByName(d.filter("_cell IS NULL").select(*out))
