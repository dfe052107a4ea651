"""Filter URLs by rules, and by path templates learned from labelled pages.

Templates. Every path is a sequence of segments. Level by level and per host, a segment value stays literal if it
holds at least MIN_SHARE of the pages below its parent template (so a parent has at most 1 / MIN_SHARE
literal children of this sort), or if it has MIN_LABELLED labelled pages that differ, by a two-sample G-test, from
the others of its wildcard; else it becomes the wildcard of its kind: digits, digits with an ending, hexadecimal
or text. Levels go on beyond MAX_DEPTH as long as a host has MIN_LABELLED labelled pages there; the rest of
a path shares one wildcard. Then the children of a parent that have
statistically similar labels, by a two-sample G-test, are merged into one branch, from the top down.
A template is rejected if its smoothed share of bad labelled pages, drawn to the host's and that to the whole
table's share, reaches REJECT.

Rules (host suffix and path prefix) come before templates; the longest rule that fits wins.

Defined cases: a null url, or one without ``://``, has an empty host and path and the template of the empty
path. Repeated pages count each time. A page without label counts for the tree's shape only.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.session import store

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
MAX_DEPTH = 6
MIN_SHARE = 0.02
MIN_LABELLED = 20
NAMED = 60                     # members a branch's name lists; of more, the first, their number and a hash
G_LIMIT = 3.841                # chi-square, one degree of freedom, 5 %
SMOOTH = 20.0                  # labelled pages the wider share counts for
REJECT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    # (?s) as a host may hold line breaks
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = None, None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    return rule, verdict


def _kind(segment: Column) -> Column:
    return (F.when(segment.rlike(r"^[0-9]+$"), "{digits}").when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]{1,5}$"), "{digits.ending}")
            .when(segment.rlike(r"^[0-9a-fA-F-]{8,}$"), "{hex}").when(segment == "", "").otherwise("{text}"))


def _gain(bad_a, good_a, bad_b, good_b) -> np.ndarray:
    """Two-sample G statistic."""
    t = np.array([[bad_a, good_a], [bad_b, good_b]], float)
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / np.maximum(t.sum((0, 1)), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * np.nansum(np.where(t > 0, t * np.log(t / e), 0), axis=(0, 1))


def _differs(bad: Column, labelled: Column, all_bad: Column, all_labelled: Column) -> Column:
    """Whether a part's labels differ from those of the rest of the whole, by the same statistic."""
    def cell(t, row, col):
        return F.when(t > 0, t * F.log(t * all_labelled / (row * col))).otherwise(0.0)
    rest, rest_bad, good = all_labelled - labelled, all_bad - bad, all_labelled - all_bad
    return 2 * (cell(bad, labelled, all_bad) + cell(labelled - bad, labelled, good) + cell(rest_bad, rest, all_bad) + cell(rest - rest_bad, rest, good)) >= G_LIMIT


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """Branch names for the children of one parent: similar label shares get one name."""
    g = group.sort_values("child", ignore_index=True)
    rate = (g.bad + 0.5) / (g.labelled + 1.0)
    order = np.lexsort((g.child, rate))
    branches: list[list[int]] = [[int(i)] for i in order]
    bad, good = g.bad.to_numpy(float)[order], (g.labelled - g.bad).to_numpy(float)[order]
    scores = _gain(bad[:-1], good[:-1], bad[1:], good[1:])
    while len(branches) > 1:             # neighbours in the order of their shares
        i = int(np.argmin(scores))
        if scores[i] >= G_LIMIT:
            break
        branches[i: i + 2] = [branches[i] + branches[i + 1]]
        bad[i], good[i] = bad[i] + bad[i + 1], good[i] + good[i + 1]
        bad, good, scores = np.delete(bad, i + 1), np.delete(good, i + 1), np.delete(scores, i)
        for j in (i - 1, i):
            if 0 <= j < len(scores):
                scores[j] = _gain(bad[j], good[j], bad[j + 1], good[j + 1])
    name = {}
    for b in branches:
        members = sorted(g.child[i] for i in b)
        joined = "|".join(members)
        if len(members) > NAMED:
            joined = f"{members[0]}|{len(members)} segments {hashlib.sha256(joined.encode()).hexdigest()[:16]}"
        for i in b:
            name[i] = joined if len(members) == 1 else f"({joined})"
    return pd.DataFrame({"host": g.host, "parent": g.parent, "child": g.child, "branch": [name[i] for i in range(len(g))]})


def templates(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per distinct (host, path): host, path, template, purity (smoothed share of bad pages).

    ``pages``: host, path, page_id. ``labels``: page_id, bad (0 or 1).
    """
    marks = labels.filter(F.col("bad").isNotNull()).groupBy("page_id").agg(F.max("bad").alias("bad")).withColumnRenamed("page_id", "_page")
    seen = pages.join(marks, F.col("page_id") == F.col("_page"), "left").groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"))
    parts = F.split(F.regexp_replace("path", "^/", ""), "/", -1)
    tree = store(seen.withColumn("parts", parts).withColumn("template", F.lit("")))
    total = tree.agg(F.sum("labelled"), F.sum("bad")).first()
    share = float(total[1] or 0) / float(total[0]) if total[0] else 0.0
    deep = tree.groupBy("host", F.size("parts").alias("size")).agg(F.sum("labelled").alias("labelled"))
    deep = deep.withColumn("from_here", F.sum("labelled").over(W.partitionBy("host").orderBy(F.desc("size"))))
    most, told = deep.agg(F.max("size"), F.max(F.when(F.col("from_here") >= MIN_LABELLED, F.col("size")))).first()
    depth = max(min(MAX_DEPTH, most or 0), told or 0)
    for level in range(depth):
        here = tree.withColumn("segment", F.get("parts", F.lit(level)))
        # both sides of each join are stored tables, so that a host or template with very many rows is split at run time
        sums = store(here.filter("segment IS NOT NULL").groupBy("host", "template", "segment").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")]))
        below = store(sums.groupBy("host", "template").agg(F.sum("n").alias("below")))
        sums = sums.join(below, ["host", "template"]).withColumn("child", F.when(F.col("n") >= F.greatest(F.lit(2.0), MIN_SHARE * F.col("below")), F.col("segment")).otherwise(_kind(F.col("segment"))))
        sums = store(sums.withColumn("pooled", F.col("n") < F.greatest(F.lit(2.0), MIN_SHARE * F.col("below"))))
        pools = store(sums.filter("pooled").groupBy("host", "template", "child").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
                      .withColumn("pooled", F.lit(True)))
        own = (F.col("labelled") >= MIN_LABELLED) & _differs(*map(F.col, ("bad", "labelled", "all_bad", "all_labelled")))
        sums = sums.join(pools, ["host", "template", "child", "pooled"], "left").withColumn("child", F.when(F.col("pooled") & own, F.col("segment")).otherwise(F.col("child")))
        sums = store(sums.select("host", F.col("template").alias("parent"), "segment", "child", "labelled", "bad"))
        children = sums.groupBy("host", "parent", "child").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        merged = store(children.groupBy("host", "parent").applyInPandas(_merge, "host string, parent string, child string, branch string"))
        names = store(sums.join(merged, ["host", "parent", "child"]).select(F.col("host").alias("_host"), "parent", F.col("segment").alias("_segment"), "branch"))
        tree = here.join(names, (F.col("host") == F.col("_host")) & (F.col("template") == F.col("parent")) & (F.col("segment") == F.col("_segment")), "left")
        more = F.when(F.lit(level == depth - 1) & (F.size("parts") > depth), "/**").otherwise("")
        tree = store(tree.withColumn("template", F.when(F.col("branch").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "branch", more)))
                     .select("host", "path", "n", "labelled", "bad", "parts", "template"))
    host = tree.groupBy("host").agg(((F.sum("bad") + SMOOTH * share) / (F.sum("labelled") + SMOOTH)).alias("host_share"))
    leaf = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).join(host, "host")
    leaf = leaf.select("host", "template", ((F.col("bad") + SMOOTH * F.col("host_share")) / (F.col("labelled") + SMOOTH)).alias("purity"))
    return store(tree.select("host", "path", "template").join(store(leaf), ["host", "template"]))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity: one row per row of ``pages``."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = templates(split, labels).withColumnsRenamed({"host": "_host", "path": "_path"})
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    out = split.join(found, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")))
    return out.select("page_id", "host", "path", rule.alias("rule"),
                      F.coalesce(says, F.when(F.col("purity") >= reject, "block").otherwise("allow")).alias("verdict"), "template", "purity")
