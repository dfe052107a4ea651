"""Remove lines that stand on many sites (DataFrame functions only).

Per line hash one aggregation gives the number of occurrences and a HyperLogLog sketch of the sites;
partial sketches merge before and after the shuffle, so a line of a third of all rows is one small
row per task. A line with fewer occurrences than ``min_sites`` is kept at once. An estimate well above
the threshold marks a line as boilerplate, one well below keeps it, and lines in between get an exact
distinct count. One occurrence, the first by (doc_id, position), stays, so content is never lost.

Defined cases: lines are compared without blanks at their ends; blank lines stay. A null text stays
null. A null source is no site. Rows that repeat an id are treated as one document, read by its text.
Other columns are kept as they are, but for n_lines and n_removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.session import store

LG_K = 12
MARGIN = 4 * 1.04 / (1 << LG_K) ** 0.5        # four standard errors of a sketch


def _lines(docs: DataFrame) -> DataFrame:
    line = F.trim(F.col("_l_line"))
    return (docs.select("_l_row", "source", F.posexplode(F.split("text", "\n", -1)).alias("_l_pos", "_l_line")).filter(line != "")
            .select("_l_row", "source", "_l_pos", F.xxhash64(line).alias("_h1"), F.xxhash64(F.lit(7), line).alias("_h2")))


def boilerplate(docs: DataFrame, min_sites: int) -> DataFrame:
    """(_h1, _h2, _first): hashes of the lines to remove and the occurrence that stays."""
    lines = _lines(docs)
    spread = lines.groupBy("_h1", "_h2").agg(
        F.count(F.lit(1)).alias("_n"), F.hll_sketch_agg("source", LG_K).alias("_sketch"), F.min(F.struct("_l_row", "_l_pos")).alias("_first"))
    spread = spread.filter(F.col("_n") >= min_sites).withColumn("_sites", F.hll_sketch_estimate("_sketch")).drop("_sketch")
    slack = max(1.0, MARGIN * min_sites)
    spread = store(spread.filter(F.col("_sites") >= min_sites - slack))
    sure = spread.filter(F.col("_sites") > min_sites + slack)
    near = spread.filter(F.col("_sites") <= min_sites + slack)
    exact = (lines.join(near.select("_h1", "_h2"), ["_h1", "_h2"], "left_semi").groupBy("_h1", "_h2")
             .agg(F.countDistinct("source").alias("_exact")).filter(F.col("_exact") >= min_sites))
    near = near.join(exact.select("_h1", "_h2"), ["_h1", "_h2"], "left_semi")
    return store(sure.unionByName(near).select("_h1", "_h2", "_first"))


def strip_lines(docs: DataFrame, min_sites: int = 10) -> DataFrame:
    """All columns of ``docs`` with the shortened text, plus n_lines and n_removed."""
    # ids may repeat: a row is known by its id and a hash of its text
    row = F.struct(F.col("doc_id"), F.xxhash64("text"))
    keyed = docs.withColumn("_l_row", row)
    marked = boilerplate(keyed, min_sites)
    hits = (_lines(keyed).join(marked, ["_h1", "_h2"])
            .filter((F.col("_l_row") != F.col("_first._l_row")) | (F.col("_l_pos") != F.col("_first._l_pos")))
            .groupBy(F.col("_l_row").alias("_l_hit")).agg(F.collect_set("_l_pos").alias("_l_gone")))
    out = keyed.join(hits, F.col("_l_row").eqNullSafe(F.col("_l_hit")), "left")
    # a one-element array binds the split text once for the inner function
    kept = F.transform(F.array(F.split("text", "\n", -1)), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_l_gone")), lambda i: F.get(lines, i)), "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return out.withColumns({
        "n_lines": n.cast("long"), "n_removed": F.when(F.col("_l_gone").isNull(), 0).otherwise(F.size("_l_gone")).cast("long"),
        "text": F.when(F.col("_l_gone").isNull(), F.col("text")).otherwise(kept[0]),
    }).drop("_l_row", "_l_hit", "_l_gone")
