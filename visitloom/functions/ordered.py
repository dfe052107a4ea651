"""Ordered scans (running sums, lag/lead, next/previous known value) that survive hot keys.

A Spark window keeps each partition key in one task. That is right for millions of ordinary
customers and wrong for one key with a third of all rows. ``lay_track`` counts rows per key once:
when no key is too large, ``scan`` is an ordinary window. Otherwise the rows of the large keys are
range-partitioned by (key, order) into blocks; a scan then runs per (key, block) and adds a
carry that comes from one summary row per block, a table whose size is bounded by ``MAX_BLOCKS``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.session import settle, store

BLOCK = "_block"
MIN_ROWS = 2_000_000     # a key below this many rows is never split
MAX_BLOCKS = 100_000     # a key is large when it exceeds total / MAX_BLOCKS rows as well


@dataclass(frozen=True)
class Track:
    keys: tuple[str, ...]
    order: tuple[str, ...]
    descending: tuple[str, ...] = ()
    blocked: bool = False
    laid: DataFrame | None = field(default=None, compare=False, repr=False)

    def sort(self) -> list[Column]:
        # Nulls sort last in both directions, the same in every engine we compare with.
        return [
            F.col(c).desc_nulls_last() if c in self.descending else F.col(c).asc_nulls_last()
            for c in self.order
        ]

    def window(self):
        keys = [*self.keys, BLOCK] if self.blocked else list(self.keys)
        return W.partitionBy(*keys).orderBy(*self.sort())

    def window_back(self):
        """The same rows from the last to the first."""
        keys = [*self.keys, BLOCK] if self.blocked else list(self.keys)
        return W.partitionBy(*keys).orderBy(*[
            F.col(c).asc_nulls_first() if c in self.descending else F.col(c).desc_nulls_first()
            for c in self.order
        ])


def large_keys(df: DataFrame, keys, min_rows: int | None = None) -> tuple[DataFrame | None, int, int]:
    """Keys too large for one task as (key table, rows they hold, rows per block).

    At most ``MAX_BLOCKS`` keys can exceed the limit, so the table is safe to broadcast.
    """
    # The row count reads no column of a stored table, and a table no larger than one block has
    # no large key at all.
    total = df.count()
    limit = max(MIN_ROWS if min_rows is None else min_rows, math.ceil(total / MAX_BLOCKS))
    if total <= limit:
        return None, 0, limit
    if not keys:
        return None, total, limit
    per_key = df.groupBy(*[F.col(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    hot = settle(per_key.filter(F.col("_n") > limit))
    rows = hot.agg(F.sum("_n")).first()[0] or 0
    return hot.drop("_n"), rows, limit


def lay_track(
    df: DataFrame, keys, order, descending=(), min_rows: int | None = None, sized_by: DataFrame | None = None
) -> tuple[DataFrame, Track]:
    """Prepare ``df`` for scans per ``keys`` in ``order`` (the order must be total per key).

    ``sized_by`` is a cheaper table with at least as many rows per key to count on. Pass inputs
    that are stored or one scan away; anything deeper is best stored first.
    """
    keys, order, descending = tuple(keys), tuple(order), tuple(descending)
    hot, rows, limit = large_keys(df if sized_by is None else sized_by, keys, min_rows)
    if rows == 0:
        return df, Track(keys, order, descending)
    pieces = min(MAX_BLOCKS, max(2, math.ceil(rows / limit)))
    hot = F.broadcast(hot.toDF(*[f"_hot_{k}" for k in keys])) if keys else None
    if keys:
        cond = F.lit(True)
        for k in keys:
            cond = cond & df[k].eqNullSafe(hot[f"_hot_{k}"])
        big = df.join(hot, cond, "left_semi")
        rest = df.join(hot, cond, "left_anti").withColumn(BLOCK, F.lit(0))
    else:
        big, rest = df, None
    sort = Track(keys, order, descending).sort()
    big = big.repartitionByRange(pieces, *[F.col(k) for k in keys], *sort)
    big = big.withColumn(BLOCK, F.spark_partition_id() + 1)
    # The block of a row must be the same for every later reader, so the layout is written once.
    laid = store(big if rest is None else big.unionByName(rest))
    return laid, Track(keys, order, descending, blocked=True, laid=laid)


def scan(df: DataFrame, track: Track, **outputs: tuple[str, str | Column | None]) -> DataFrame:
    """Add ordered columns: ``name=(kind, column)``.

    kinds: ``row_number``, ``running_sum``, ``prior_sum``, ``lag``, ``lead``,
    ``last_known`` (previous non-null, current row included),
    ``next_known`` (next non-null, current row included).
    """
    w = track.window()
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    # Rows still to come are read from the end: a frame up to the last row is evaluated anew for every row,
    # which is quadratic in the rows of a key.
    onward = track.window_back().rowsBetween(W.unboundedPreceding, W.currentRow)
    if track.blocked:
        return _blocked_scan(df, track, outputs, w, upto, before, onward)
    cols = {}
    for name, (kind, source) in outputs.items():
        c = F.col(source) if isinstance(source, str) else source
        if kind == "row_number":
            cols[name] = F.row_number().over(w).cast("long")
        elif kind == "running_sum":
            cols[name] = F.sum(c).over(upto)
        elif kind == "prior_sum":
            cols[name] = F.coalesce(F.sum(c).over(before), F.lit(0))
        elif kind in ("lag", "lead"):
            cols[name] = getattr(F, kind)(c).over(w)
        elif kind == "last_known":
            cols[name] = F.last(c, ignorenulls=True).over(upto)
        elif kind == "next_known":
            cols[name] = F.last(c, ignorenulls=True).over(onward)
        else:
            raise ValueError(f"unknown scan kind {kind}")
    return df.withColumns(cols)


def _blocked_scan(df, track, outputs, w, upto, before, onward):
    if df is not track.laid:
        df = store(df)  # read by the block summaries and by the scan itself
    keys = list(track.keys)
    sources = {
        f"_in_{n}": (F.lit(1) if s is None else F.col(s) if isinstance(s, str) else s)
        for n, (_, s) in outputs.items()
    }
    prepared = df.withColumns(sources)
    wb = track.window()
    edge = prepared.withColumns({
        "_at": F.row_number().over(wb),
        "_of": F.count(F.lit(1)).over(wb.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
    })
    first = lambda c: F.max(F.when(F.col("_at") == 1, F.struct(c)))
    last = lambda c: F.max(F.when(F.col("_at") == F.col("_of"), F.struct(c)))

    # one row per (key, block): what a neighbour block needs to know
    aggs = []
    for n, (kind, _) in outputs.items():
        c = F.col(f"_in_{n}")
        if kind in ("row_number", "running_sum", "prior_sum"):
            aggs.append(F.sum(c).alias(f"_s_{n}"))
        elif kind == "lag":
            aggs.append(last(c.alias("v")).alias(f"_s_{n}"))
        elif kind == "lead":
            aggs.append(first(c.alias("v")).alias(f"_s_{n}"))
        elif kind == "last_known":
            aggs.append(F.max_by(c, F.when(c.isNotNull(), F.col("_at"))).alias(f"_s_{n}"))
        elif kind == "next_known":
            aggs.append(F.min_by(c, F.when(c.isNotNull(), F.col("_at"))).alias(f"_s_{n}"))
        else:
            raise ValueError(f"unknown scan kind {kind}")
    blocks = edge.filter(F.col(BLOCK) > 0).groupBy(*keys, BLOCK).agg(*aggs)
    wk = W.partitionBy(*keys).orderBy(BLOCK)
    prior = wk.rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(*keys).orderBy(F.col(BLOCK).desc()).rowsBetween(W.unboundedPreceding, -1)
    carry = []
    for n, (kind, _) in outputs.items():
        s = F.col(f"_s_{n}")
        if kind in ("row_number", "running_sum", "prior_sum"):
            carry.append(F.sum(s).over(prior).alias(f"_c_{n}"))
        elif kind == "lag":
            carry.append(F.lag(s).over(wk).alias(f"_c_{n}"))
        elif kind == "lead":
            carry.append(F.lead(s).over(wk).alias(f"_c_{n}"))
        elif kind == "last_known":
            carry.append(F.last(s, ignorenulls=True).over(prior).alias(f"_c_{n}"))
        else:
            carry.append(F.last(s, ignorenulls=True).over(after).alias(f"_c_{n}"))
    carries = blocks.select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                            F.col(BLOCK).alias("_kb"), *carry)
    cond = prepared[BLOCK] == carries["_kb"]
    for k in keys:
        cond = cond & prepared[k].eqNullSafe(carries[f"_k_{k}"])
    joined = prepared.join(F.broadcast(carries), cond, "left")

    cols = {}
    for n, (kind, _) in outputs.items():
        c, k = F.col(f"_in_{n}"), F.col(f"_c_{n}")
        if kind == "row_number":
            cols[n] = F.row_number().over(w).cast("long") + F.coalesce(k, F.lit(0))
        elif kind == "running_sum":
            local = F.sum(c).over(upto)
            cols[n] = F.when(local.isNull(), k).otherwise(local + F.coalesce(k, F.lit(0)))
        elif kind == "prior_sum":
            cols[n] = F.coalesce(F.sum(c).over(before), F.lit(0)) + F.coalesce(k, F.lit(0))
        elif kind in ("lag", "lead"):
            cols[n] = F.coalesce(getattr(F, kind)(F.struct(c.alias("v"))).over(w), k)["v"]
        elif kind == "last_known":
            cols[n] = F.coalesce(F.last(c, ignorenulls=True).over(upto), k)
        else:
            cols[n] = F.coalesce(F.last(c, ignorenulls=True).over(onward), k)
    drop = [*sources, "_kb", *[f"_k_{k}" for k in keys], *[f"_c_{n}" for n in outputs]]
    return joined.withColumns(cols).drop(*drop)


def lift_off(df: DataFrame) -> DataFrame:
    """Drop the block column once no further scan follows."""
    return df.drop(BLOCK)


def spread(df: DataFrame, keys, min_rows: int | None = None, sized_by: DataFrame | None = None,
           **aggs: Column) -> DataFrame:
    """Put group aggregates on every row of the group.

    ``sized_by`` is an earlier, narrower form of ``df`` with the same rows per key to count on.

    A window (one exchange) while groups are ordinary; the rows of large groups skip the
    window and take their aggregate from a broadcast table with one row per large group.
    """
    keys = list(keys)
    hot, rows, _ = large_keys(df if sized_by is None else sized_by, keys, min_rows)
    w = W.partitionBy(*keys)
    windowed = {n: a.over(w) for n, a in aggs.items()}
    if rows == 0:
        return df.withColumns(windowed)
    df = store(df)
    hot = F.broadcast(hot.toDF(*[f"_hot_{k}" for k in keys]))
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(hot[f"_hot_{k}"])
    big = df.join(hot, cond, "left_semi")
    sums = big.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()])
    sums = F.broadcast(sums.toDF(*[f"_hot_{k}" for k in keys], *aggs))
    cond2 = F.lit(True)
    for k in keys:
        cond2 = cond2 & big[k].eqNullSafe(sums[f"_hot_{k}"])
    big = big.join(sums, cond2).drop(*[f"_hot_{k}" for k in keys])
    return df.join(hot, cond, "left_anti").withColumns(windowed).unionByName(big)


ALL = "_all"


def quantiles(df: DataFrame, value: str, probs, by=(), min_rows: int | None = None, n: str | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles, one column ``q0..qn`` per probability.

    Works on value counts and an ordered scan, so no group is held in one task's memory. ``n`` names a column
    that says how often a row counts.
    """
    by = list(by) or [ALL]
    base = df.withColumn(ALL, F.lit(0)) if by == [ALL] else df
    counts = (base.filter(F.col(value).isNotNull())
              .groupBy(*by, F.col(value).cast("double").alias("_v"))
              .agg((F.sum(n) if n else F.count(F.lit(1))).alias("_n")))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("_total"))
    laid, track = lay_track(counts, by, ["_v"], min_rows=min_rows)
    ranked = lift_off(scan(laid, track, _to=("running_sum", "_n"))).join(totals, by)
    start, last = F.col("_to") - F.col("_n"), F.col("_total") - 1
    aggs = []
    for i, p in enumerate(probs):
        rank = F.lit(float(p)) * last
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            inside = (start <= at) & (at < F.col("_to"))
            aggs.append(F.max(F.when(inside, F.col("_v"))).alias(f"_{side}{i}"))
    out = ranked.groupBy(*by, "_total").agg(*aggs)
    cols = []
    for i, p in enumerate(probs):
        rank = F.lit(float(p)) * last
        frac = rank - F.floor(rank)
        cols.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac).alias(f"q{i}"))
    return out.select(*by, *cols)


def split_rank(df: DataFrame, keys, order, descending=(), name="rn", min_rows=None) -> DataFrame:
    """``row_number`` per key that may be a handful of huge groups."""
    laid, track = lay_track(df, keys, order, descending, min_rows)
    return lift_off(scan(laid, track, **{name: ("row_number", None)}))
