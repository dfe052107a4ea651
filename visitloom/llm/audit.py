"""How filters interact: what each one removes, finds already removed, or alone would remove, in every order.

Each filter has one table with the ids of the documents that fail it. The survivors of a set of filters are the
survivors of the set without its last filter, left-anti-joined with that filter's table; what filter f removes
after a set are the set's survivors, left-semi-joined with the table of f. A prefix of an order matters only as
a set, so 2^k sets stand for all orders of k filters, and sets of one size are worked on together: a level of
survivors is written once and feeds the next. Counts by part and set are small and give all orders.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.llm.common import from_texts
from visitloom.session import store

MARKS = b"#$%&*|"
CAPITALS = bytes(range(65, 91))
FIGURES = "n_words bigint, n_distinct bigint, n_capitals bigint, n_points bigint, n_marks bigint"


def _figures() -> Callable[[list], list[tuple]]:
    def judge(texts: list) -> list[tuple]:
        out = []
        for t in texts:
            raw = (t or "").encode()
            words = raw.split()
            out.append((len(words), len(set(words)), len(raw) - len(raw.translate(None, CAPITALS)), len(t or ""),
                        len(raw) - len(raw.translate(None, MARKS))))
        return out
    return judge


def text_figures(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and, of whole texts, words (all, distinct), ASCII capitals, code points and marks ``#$%&*|``. Null is empty."""
    return from_texts(df, keep, _figures, FIGURES)


def later_copies(df: DataFrame, key: str) -> DataFrame:
    """The ``key`` of rows whose ``digest`` also occurs with a smaller ``doc_id``; null ids are neither smaller nor larger."""
    first = (df.groupBy("digest").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"))
             .filter("_first < _last").select(F.col("digest").alias("_d"), "_first"))
    return df.join(first, (F.col("digest") == F.col("_d")) & (F.col("doc_id") > F.col("_first"))).select(key)


def prefix_counts(base: DataFrame, failing: dict[str, DataFrame], part: str = "part") -> tuple[DataFrame, DataFrame]:
    """(survivors, removals) by part and set of filters.

    ``base`` has one row per document: key, part, good, toxic (0/1). ``failing`` has the keys that fail each filter.
    A set is a bit mask over the filters in their given order. survivors: part, before, kept. removals: part,
    before (the set applied earlier), filter (its number), removed, good_lost, toxic_lost. Combinations without
    documents have no row.
    """
    bits = {name: 1 << i for i, name in enumerate(failing)}
    tables = {name: t.select("key") for name, t in failing.items()}
    levels = [base.select("key", part, "good", "toxic", F.lit(0).alias("before"))]
    for _ in failing:
        last = levels[-1]
        grown = [last.filter(F.col("before") < bits[f]).join(t, "key", "left_anti").withColumn("before", F.col("before") + bits[f])
                 for f, t in tables.items()]
        level = grown[0]
        for g in grown[1:]:
            level = level.unionByName(g)
        levels.append(store(level))
    alive = levels[0]
    for level in levels[1:]:
        alive = alive.unionByName(level)
    kept = alive.groupBy(part, "before").agg(F.count(F.lit(1)).alias("kept"))
    lost = None
    for i, (f, t) in enumerate(tables.items()):
        hit = alive.filter(F.col("before").bitwiseAND(bits[f]) == 0).join(t, "key", "left_semi")
        hit = hit.groupBy(part, "before").agg(F.count(F.lit(1)).alias("removed"), F.sum("good").alias("good_lost"), F.sum("toxic").alias("toxic_lost")).withColumn("filter", F.lit(i))
        lost = hit if lost is None else lost.unionByName(hit)
    return kept, lost


def order_steps(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    """filter_order, step, filter (number), before, after for all orders of the filters: k! times k rows."""
    names = list(names)
    rows = []
    for order in permutations(range(len(names))):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(names[i] for i in order), step, f, before, before | 1 << f))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int, after int")


def audit(base: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """One row per part, order and step, zeros included; see ``op11_filter_audit`` for the columns.

    ``base`` (key, part, good, toxic) and the ``failing`` tables are best stored. With an empty ``base`` there is no
    part, hence no row. Filters may fail nothing or all documents. Keys must be unique and not null.
    """
    spark = base.sparkSession
    names = list(failing)
    kept, lost = (store(x) for x in prefix_counts(base, failing))
    parts = kept.select("part").distinct()
    steps = store(order_steps(spark, names))
    # every part meets every step through the step's filter number
    grid = parts.withColumn("filter", F.explode(F.array(*[F.lit(i) for i in range(len(names))]))).join(F.broadcast(steps), "filter")
    whole = lost.filter("before = 0").select("part", "filter", F.col("removed").alias("failing"))
    every = (1 << len(names)) - 1
    only = lost.join(F.broadcast(spark.createDataFrame([(i, every ^ (1 << i)) for i in range(len(names))], "filter int, before int")), ["filter", "before"])
    only = only.select("part", "filter", F.col("removed").alias("unique_fails"))
    out = (grid.join(kept.withColumnRenamed("before", "after"), ["part", "after"], "left")
           .join(lost, ["part", "filter", "before"], "left")
           .join(whole, ["part", "filter"], "left").join(only, ["part", "filter"], "left"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = out.select("part", "filter_order", "step", "filter", zero("kept").alias("kept"), zero("removed").alias("removed"),
                     (zero("failing") - zero("removed")).alias("redundant"), zero("unique_fails").alias("unique_fails"),
                     zero("good_lost").alias("good_lost"), zero("toxic_lost").alias("toxic_lost"))
    share = out.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return out.join(share, ["part", "filter"]).drop("filter")


def failing_tables(figures: DataFrame, conditions: dict[str, Column], stored: bool = True) -> dict[str, DataFrame]:
    """One table of keys per filter, of the rows that meet its failure condition; null is no failure."""
    out = {name: figures.filter(c).select("key") for name, c in conditions.items()}
    return {name: store(t) for name, t in out.items()} if stored else out


def audit_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five text filters over whole documents, by language.

    Filters fail on: A under 200 words; B distinct words under half of the words; C ASCII capitals over 3 % of the
    code points; D any of ``#$%&*|``; E the text of a document with a smaller id. Rows count, not ids: repeated rows
    count each, also for labels; a null id has no labels and never fails E. Null texts are empty, hence equal.
    An id labelled several times has a label if any of its rows has it. Part is the language, null as ''.
    """
    docs = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("part"))
    digested = docs.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    figures = text_figures(digested, ["doc_id", "part", "digest"])
    # the running number is written with the row, so later readers agree on it
    figures = store(figures.withColumn("key", F.monotonically_increasing_id()))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    base = figures.select("key", "part", "doc_id").join(marks, F.col("doc_id") == F.col("_id"), "left")
    base = store(base.select("key", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))
    failing = failing_tables(figures, {
        "A": F.col("n_words") < 200,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > 3 * F.col("n_points"),
        "D": F.col("n_marks") > 0,
    })
    failing["E"] = store(later_copies(figures.select("key", "doc_id", "digest"), "key"))
    return audit(base, failing)
