"""Find benchmark passages in documents by winnowing.

A passage is any ``span`` consecutive words of an item (a shorter item is one passage). Of every ``span``
words the smallest hash of their word k-grams is kept, the rightmost on ties. The choice
depends on these words alone, so a text that holds a whole passage keeps the same k-gram at the same
place, and joining the kept hashes misses none. Documents' hashes are first thinned out by a membership bitmap of the
benchmark's (bounded in size), then joined exactly. Every kept hash carries the words around it, and a hit
is extended by comparing the words themselves, so a collision of hashes cannot report anything.
Items of n < span words are matched by the hash of all n words, taken at every position of a document.

Defined cases: null has no words. Repeated items are all reported; repeated document ids count as rows of
their own. Without items nothing is hit. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.llm.common import is_member, membership
from visitloom.llm.words import LOWER, grams, hashed
from visitloom.session import store

SPAN = 10
K = 5
FOUND = "row long, doc_id long, n_words long, length int, hash long, at long, first long, around array<string>"


def _winnow(h: np.ndarray, counts: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the kept k-grams and their hashes, for texts of ``counts`` words after each other."""
    g = grams(h, k)
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), g[:0]
    width = span - k + 1
    least = g[:n].copy()
    for j in range(1, width):
        np.minimum(least, g[j: j + n], out=least)
    # windows that cross from one text into the next do not count
    past = np.repeat(np.cumsum(counts), counts)[:n]
    open_ = np.arange(n) + span <= past
    kept = np.zeros(len(g), bool)
    for j in range(width - 1, -1, -1):
        here = open_ & (g[j: j + n] == least)
        kept[np.flatnonzero(here) + j] = True
        open_ &= ~here
    at = np.flatnonzero(kept)
    return at, g[at]


def _whole(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Every run of n words inside one text, with its hash."""
    g = grams(h, n, salt=n)
    past = np.repeat(np.cumsum(counts), counts)[: len(g)]
    at = np.flatnonzero(np.arange(len(g)) + n <= past)
    return at, g[at]


def _fingerprints(span: int, k: int, lengths: tuple[int, ...], bits: np.ndarray | None, items: bool):
    """mapInArrow function over (row, doc_id, text): kept hashes with the words around them.

    For documents there is also one row per text, without a hash, that carries the number of words.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2)
            for i, j, h, counts, first, past in hashed(texts):
                starts = np.concatenate([[0], np.cumsum(counts)])
                found = []
                for n in (span, *lengths):
                    at, g = _winnow(h, counts, span, k) if n == span else _whole(h, counts, n)
                    if items and n < span:      # an item is short as a whole
                        doc = np.searchsorted(starts, at, "right") - 1
                        at, g = at[counts[doc] == n], g[counts[doc] == n]
                    if bits is not None and len(g):
                        ok = is_member(bits, g.view(np.int64))
                        at, g = at[ok], g[ok]
                    found.append((n, at, g))
                text_bytes: dict[int, bytes] = {}
                base = np.concatenate([[0], np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in texts.cast(pa.large_binary())[i:j]])]) if any(len(a) for _, a, _ in found) else None
                out = [] if items else [(rows[i + d], ids[i + d], int(counts[d]), None, None, None, None, None) for d in range(j - i)]
                for n, at, g in found:
                    for p, value in zip(at.tolist(), g.view(np.int64).tolist()):
                        d = int(np.searchsorted(starts, p, "right")) - 1
                        if d not in text_bytes:
                            text_bytes[d] = LOWER[np.frombuffer(texts[i + d].as_py().encode(), np.uint8)].tobytes()
                        reach = (span - k, span) if n == span else (0, n)
                        lo, hi = max(starts[d], p - reach[0]), min(starts[d + 1], p + reach[1])
                        words = [text_bytes[d][first[x] - base[d]: past[x] - base[d]].decode() for x in range(lo, hi)]
                        out.append((rows[i + d], ids[i + d], int(counts[d]), n, value, p - int(starts[d]), int(lo - starts[d]), words))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], names=NAMES)
    return run


NAMES = ["row", "doc_id", "n_words", "length", "hash", "at", "first", "around"]
TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
HITS = "row long, item_id long, start long, past long"


def _extended(span: int):
    """Word runs of a document that are passages of the item, around one shared hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row, item, length, at, first, around, i_at, i_first, i_around in zip(*(b.column(c).to_pylist() for c in range(9))):
                shift, left = at - first, i_at - i_first
                back = min(shift, left)
                ahead = min(len(around) - shift, len(i_around) - left)
                same = [around[shift + x] == i_around[left + x] for x in range(-back, ahead)]
                covered = None
                for x in range(0, len(same) - length + 1):
                    if all(same[x: x + length]):
                        lo = at - back + x
                        covered = (covered[0] if covered else lo, lo + length)
                if covered:
                    out.append((row, item, *covered))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["row", "item_id", "start", "past"])
    return run


def find_passages(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(texts, hits): ``texts`` is row, doc_id, n_words; ``hits`` is row, item_id, start, past in words."""
    items = benchmark.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("doc_id"), "text")
    short = items.select(F.regexp_count(F.lower("text"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).alias("n")).filter(F.col("n") < span).filter("n > 0").distinct()
    lengths = tuple(sorted(r.n for r in short.collect()))                # at most span - 1 numbers
    prints = store(items.mapInArrow(_fingerprints(span, k, lengths, None, True), FOUND)
                   .select(F.col("doc_id").alias("item_id"), F.col("length").alias("i_length"), F.col("hash").alias("i_hash"),
                           F.col("at").alias("i_at"), F.col("first").alias("i_first"), F.col("around").alias("i_around")))
    bits = membership(prints, "i_hash", prints.count())
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = store(named.mapInArrow(_fingerprints(span, k, lengths, bits, False), FOUND))
    texts = found.filter("hash IS NULL").select("row", "doc_id", "n_words")
    pairs = (found.filter("hash IS NOT NULL").join(prints, (F.col("hash") == F.col("i_hash")) & (F.col("length") == F.col("i_length")))
             .select("row", "item_id", "length", "at", "first", "around", "i_at", "i_first", "i_around"))
    return texts, pairs.mapInArrow(_extended(span), HITS)


def report(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per document."""
    texts, hits = find_passages(docs, benchmark, span, k)
    hits = store(hits.distinct())
    # union of the word runs: a run adds what lies beyond the furthest end before it
    w = W.partitionBy("row").orderBy("start", "past").rowsBetween(W.unboundedPreceding, -1)
    runs = hits.select("row", "start", "past").distinct().withColumn("_end", F.coalesce(F.max("past").over(w), F.lit(0).cast("long")))
    words = runs.groupBy("row").agg(F.sum(F.greatest(F.lit(0).cast("long"), F.col("past") - F.greatest("start", "_end"))).alias("n_hit"))
    named = hits.select("row", F.col("item_id").cast("string").alias("item")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("_items"))
    out = texts.join(words, "row", "left").join(named, "row", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("_items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0).cast("long")) > 0).alias("contaminated"))
