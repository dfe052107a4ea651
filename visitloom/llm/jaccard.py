"""Join documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. One pass gives each text a 128-bit key of its words and 96 MinHash values. Equal word sequences become
   one text with a number of copies.
2. Texts that share any of 24 bands of 4 values are candidates. At the threshold a pair is missed with
   probability (1 - 0.8^4)^24 = 3e-6. No bucket is capped.
3. Candidates are laid out in blocks of a few hundred texts; texts that share bands are put into one block
   as far as possible. Two blocks are compared if a band bucket reaches into both, so every candidate pair
   is compared, each once, and the rows of a large bucket are sent per block, not per pair.
4. Inside a pair of blocks MinHash values are compared in steps of 16. With m of n equal, a uniform prior gives the
   similarity a Beta(m + 1, n - m + 1) distribution; a pair is dropped when the probability of reaching the
   threshold is below the tolerance. The rest is verified exactly on the shingle sets.
5. A block pair returns per text the documents it is linked with and one spanning edge. Components of the edges
   are the classes.

Defined cases: words as in ``words``. A text of one to four words has one shingle, all its words. A text
without words (null too) is linked to nothing, not even its equals. Repeated ids are rows of their own.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import is_member, membership
from visitloom.llm.components import components
from visitloom.llm.words import _power, grams, hashed
from visitloom.session import store

WORDS = 5
BANDS, ROWS = 24, 4
STEP = 16
BLOCK_TEXTS, BLOCK_WORDS = 384, 2_000_000
SEEDS = np.random.default_rng(20240607).integers(1, 1 << 63, BANDS * ROWS).astype(np.uint64) | np.uint64(1)
EVEN = np.uint64(32)
KEY_BASES = 0xA24BAED4963EE407, 0x9FB21C651E98DF25


def _shingles(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts after each other, and how many each text has."""
    each = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    out = np.empty(int(each.sum()), np.uint64)
    full = np.repeat(counts >= k, each)
    g = grams(h, k)
    past = np.repeat(np.cumsum(counts), counts)[: len(g)]
    out[full] = g[np.arange(len(g)) + k <= past]
    starts = np.cumsum(counts) - counts
    out[~full] = [grams(h[s: s + n], int(n), salt=int(n))[0] for s, n in zip(starts, counts) if 0 < n < k]
    return out, each


def _keys(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The texts that have words, and 128 bits of the word sequence of each."""
    have = np.flatnonzero(counts)
    if not len(have):
        return have, []
    starts = (np.cumsum(counts) - counts)[have]
    at = np.arange(len(h)) - np.repeat(starts, counts[have])
    a, b = (np.add.reduceat(h * _power(base, int(counts.max()))[at], starts) for base in KEY_BASES)
    return have, [x.tobytes() + y.tobytes() for x, y in zip(a, b)]


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, counts, _, _ in hashed(batch.column(1)):
                have, found = _keys(h, counts)
                keys: list = [None] * (j - i)
                sigs: list = [None] * (j - i)
                if len(have):
                    s, each = _shingles(h, counts, k)
                    first = (np.cumsum(each) - each)[have]
                    sig = np.empty((len(have), len(SEEDS)), np.uint32)
                    for c, seed in enumerate(SEEDS):
                        sig[:, c] = np.minimum.reduceat(((s * seed) >> EVEN).astype(np.uint32), first)
                    for n, d in enumerate(have.tolist()):
                        keys[d], sigs[d] = found[n], sig[n].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(counts), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                    names=["doc_id", "n_words", "key", "sig"])
    return run


def _sets(k: int, bits: np.ndarray):
    """Sorted shingle sets of the documents that may be candidates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(is_member(bits, ids))
            if not len(keep):
                continue
            rows = batch.take(pa.array(keep))
            for i, j, h, counts, _, _ in hashed(rows.column(1)):
                have, keys = _keys(h, counts)
                if not len(have):
                    continue
                s, each = _shingles(h, counts, k)
                sets = [np.unique(x).view(np.int64) for x in np.split(s, np.cumsum(each)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).slice(i, j - i).take(pa.array(have)).cast(pa.int64()), pa.array(keys, pa.binary()),
                     pa.array([sets[d] for d in have], pa.list_(pa.int64()))], names=["doc_id", "key", "shingles"])
    return run


def least_matches(threshold: float, tolerance: float, steps: range) -> dict[int, int]:
    """For n compared values, the fewest equal ones with which P(similarity >= threshold) >= tolerance."""
    out = {}
    for n in steps:
        # P(J >= t | m of n) = P(Binomial(n + 1, t) <= m)
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out[n] = m
    return out


def _verify(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs (x, y) of positions in ``sets`` reach the threshold exactly."""
    size = np.array([len(s) for s in sets])
    if len(x) < 4 * len(sets):
        shared = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x, y)])
    else:
        left, right = np.unique(x), np.unique(y)
        used = np.union1d(left, right)
        values, ids = np.unique(np.concatenate([sets[d] for d in used]), return_inverse=True)
        owner = np.repeat(np.arange(len(used)), size[used])
        often = np.bincount(ids) > 1              # a shingle of one text is shared by no pair
        new = np.cumsum(often) - 1
        owner, ids = owner[often[ids]], new[ids[often[ids]]]
        order = np.argsort(ids, kind="stable")
        owner, ids = owner[order], ids[order]
        total = np.zeros((len(left), len(right)), np.float32)
        a, b = np.searchsorted(used, left), np.searchsorted(used, right)
        for lo in range(0, int(often.sum()), 4096):
            s, e = np.searchsorted(ids, [lo, lo + 4096])
            m = np.zeros((len(used), 4096), np.float32)
            m[owner[s:e], ids[s:e] - lo] = 1
            total += m[a] @ m[b].T
        shared = total[np.searchsorted(left, x), np.searchsorted(right, y)].astype(np.int64)
    return shared >= threshold * (size[x] + size[y] - shared) - 1e-9


def _compare(threshold: float, tolerance: float):
    n_hashes = BANDS * ROWS
    least = least_matches(threshold, tolerance, range(STEP, n_hashes + 1, STEP))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.drop_duplicates("uid").sort_values("uid", ignore_index=True)
        sig = np.frombuffer(b"".join(g.sig), np.uint32).reshape(len(g), n_hashes)
        size = np.array([len(s) for s in g.shingles])
        one, other = g.one.iloc[0], g.other.iloc[0]
        left = np.flatnonzero(g.block == one)
        right = np.flatnonzero(g.block == other)
        equal = np.zeros((len(left), len(right)), np.int16)
        for c in range(STEP):
            equal += sig[left, c][:, None] == sig[right, c][None, :]
        alive = equal >= least[STEP]
        if one == other:
            alive = np.triu(alive, 1)
        x, y = np.nonzero(alive)
        m, x, y = equal[x, y].astype(np.int64), left[x], right[y]
        for n in range(2 * STEP, n_hashes + 1, STEP):
            m = m + (sig[x, n - STEP: n] == sig[y, n - STEP: n]).sum(1)
            keep = m >= least[n]
            m, x, y = m[keep], x[keep], y[keep]
        ok = np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]) - 1e-9
        x, y = x[ok], y[ok]
        if len(x):
            ok = _verify(list(g.shingles), x, y, threshold)
            x, y = x[ok], y[ok]
        copies, root = g.copies.to_numpy(), np.arange(len(g))
        links = np.bincount(x, copies[y], len(g)) + np.bincount(y, copies[x], len(g)) if len(x) else np.zeros(len(g))
        while True:                      # smallest position of each component, by halving paths
            low = root.copy()
            np.minimum.at(low, x, root[y])
            np.minimum.at(low, y, root[x])
            low = low[low]
            if (low == root).all():
                break
            root = low
        have = np.flatnonzero(links > 0)
        uid = g.uid.to_numpy()
        return pd.DataFrame({"uid": uid[have], "links": links[have].astype(np.int64), "root": uid[root[have]]})
    return run


def link_documents(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, words: int = WORDS) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), n_links (documents at or above the threshold)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = store(base.mapInArrow(_signatures(words), "doc_id long, n_words long, key binary, sig binary"))
    groups = signed.filter("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n_words"))
    texts = store(groups.withColumn("uid", F.monotonically_increasing_id()))

    # bands that more than one text has
    mine = signed.filter("key IS NOT NULL").join(
        texts.select(F.col("key").alias("_key"), F.col("rep").alias("_rep"), "uid"), (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_rep")))
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    banded = mine.select("uid", F.explode(band).alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band")
    members = store(banded.join(shared, "band").distinct())

    # put texts that share bands side by side: two rounds of smallest labels (this steers the layout only)
    label = members.select("uid", "band", F.col("uid").alias("label"))
    for _ in range(2):
        low = label.groupBy("band").agg(F.min("label").alias("low"))
        near = members.join(low, "band").groupBy("uid").agg(F.min("low").alias("label"))
        label = members.join(near, "uid")
    near = store(near.join(texts, "uid"))
    cells = max(1, near.count() // (BLOCK_TEXTS * 2 // 3))
    near = near.withColumn("cell", F.pmod(F.xxhash64("label"), F.lit(cells)))
    parts = near.groupBy("cell").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n_words") / BLOCK_WORDS)).alias("parts"))
    blocks = store(near.join(parts, "cell").select("uid", "key", "rep", "copies", F.xxhash64("cell", F.pmod(F.xxhash64(F.lit(3), F.col("uid")), F.col("parts"))).alias("block")))

    reach = store(members.join(blocks.select("uid", "block"), "uid").select("band", "block").distinct())
    pairs = reach.join(reach.withColumnRenamed("block", "other"), "band").filter("block <= other").select(F.col("block").alias("one"), "other").distinct()
    pairs = store(pairs)
    sides = pairs.select("one", "other", F.explode(F.array_distinct(F.array("one", "other"))).alias("block"))

    bits = membership(blocks.select(F.coalesce("rep", F.lit(-1)).alias("rep")), "rep", blocks.count())
    sets = base.mapInArrow(_sets(words, bits), "doc_id long, key binary, shingles array<long>")
    sigs = signed.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "sig")
    own = lambda doc, key: F.col("rep").eqNullSafe(F.col(doc)) & (F.col("key") == F.col(key))
    full = blocks.join(sigs, own("_doc", "_key")).select("uid", "key", "rep", "copies", "block", "sig")
    full = full.join(sets.withColumnsRenamed({"doc_id": "_doc", "key": "_key"}), own("_doc", "_key")).select("uid", "copies", "block", "sig", "shingles")
    out = (full.join(sides, "block").groupBy("one", "other")
           .applyInPandas(_compare(threshold, tolerance), "uid long, links long, root long"))
    found = store(out)

    roots = components(found.select(F.col("uid").alias("u"), F.col("root").alias("v")))
    linked = texts.join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    linked = linked.join(found.groupBy("uid").agg(F.sum("links").alias("links")), "uid", "left")
    lead = linked.groupBy("root").agg(F.min("rep").alias("class_id"))
    known = (linked.filter("links IS NOT NULL OR copies > 1").join(lead, "root")
             .select(F.col("key").alias("_key"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return (signed.select("doc_id", "key").join(known, F.col("key") == F.col("_key"), "left")
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
