"""Runs of a word sequence (stretches that repeat with one period), found by dyadic square catchers.

The words of a text are appended to a ``Catcher``. For each power of two s it watches every completed block of
s words: a suffix of s words that equals the block and starts q words after it, s <= q < 2 s, reports a
repetition with period q. A report is grown to both sides as far as words q apart agree; reports that continue a
known run, or lie inside a run of a shorter period (whose multiple q then is), merge into it. Suffixes and
blocks are compared by hashes that double in length from level to level, and a report is verified on the words.
Runs of exponent 3 and more hold a whole block and its repetition, so none is missed. A batch of words advances
all catchers at once, with the same runs as word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import from_texts, quoted
from visitloom.llm.words import mix

BATCH = 1 << 20                # words of short texts worked on at once; a longer text is a batch of its own
FACTOR = np.uint64(0xD1342543DE82EF95)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _agree(w: np.ndarray, at: int, q: int, stop: int) -> int:
    """The first place t >= at, at most ``stop``, where the words t and t + q differ."""
    step = 16
    while at < stop:
        to = min(at + step, stop)
        differ = w[at:to] != w[at + q: to + q]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = to, 2 * step
    return stop


def _agree_back(w: np.ndarray, at: int, q: int) -> int:
    """The first place of the stretch before ``at`` over which words q apart agree."""
    step = 16
    while at > 0:
        low = max(0, at - step)
        differ = (w[low:at] != w[low + q: at + q])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            return at - k
        at, step = low, 2 * step
    return 0


class Catcher:
    """Repetitions of a growing word sequence with periods below ``2 ** levels``."""

    def __init__(self, levels: int) -> None:
        self.words = np.zeros(0, np.int64)
        self.hashes = [np.zeros(0, np.uint64) for _ in range(levels)]
        self.runs: list[list[int]] = []        # [first word, past the last word, period]
        self.latest: dict[int, list[int]] = {}  # the last run of each period
        self.open: list[list[int]] = []        # runs that reach the end of the words so far

    def append(self, words: np.ndarray) -> None:
        w = self.words = np.concatenate([self.words, words]) if len(self.words) else np.asarray(words, np.int64)
        n = len(w)
        for run in self.open:
            run[1] = _agree(w, run[1] - run[2], run[2], n - run[2]) + run[2]
        for level in range(len(self.hashes)):
            s = 1 << level
            at, known = self._suffixes(level, s)
            if len(at):
                same = known[at] == known[(at - s) & ~(s - 1)]
                if same.any():
                    self._report(at[same], s)
        self.open = [run for run in self.latest.values() if run[1] == n]

    def _suffixes(self, level: int, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the new suffixes of s words that have a block to be compared with; all hashes of s words."""
        n, known = len(self.words), self.hashes[level]
        done, total = len(known), max(0, n - s + 1)
        if total > done:
            if level == 0:
                more = mix(self.words[done:total].astype(np.uint64))
            else:
                half = self.hashes[level - 1]
                more = mix(half[done:total] * FACTOR + half[done + s // 2: total + s // 2])
            known = self.hashes[level] = np.concatenate([known, more]) if done else more
        return np.arange(max(done, s), total), known

    def _report(self, suffix: np.ndarray, s: int) -> None:
        block = (suffix - s) & ~(s - 1)
        period = suffix - block
        shorter = sorted((run[0], run[1]) for run in self.runs if run[2] < s)
        if shorter:
            starts = np.array([x[0] for x in shorter])
            furthest = np.maximum.accumulate(np.array([x[1] for x in shorter]))
            before = np.searchsorted(starts, block, "right") - 1
            new = (before < 0) | (furthest[np.maximum(before, 0)] < suffix + s)
            block, period = block[new], period[new]
        order = np.lexsort((block, period))
        block, period = block[order], period[order]
        cuts = np.flatnonzero(np.diff(period)) + 1
        for blocks in np.split(block, cuts):
            if len(blocks):
                self._grow(blocks, int(period[0]), s)
            period = period[len(blocks):]

    def _grow(self, blocks: np.ndarray, q: int, s: int) -> None:
        w, n, i = self.words, len(self.words), 0
        run = self.latest.get(q)
        while i < len(blocks):
            at = int(blocks[i])
            if run and at < run[1] - q:
                i = int(np.searchsorted(blocks, run[1] - q))
                continue
            past = _agree(w, at, q, n - q)
            if past >= at + s:
                first = _agree_back(w, at, q)
                if past + q - first >= 2 * q:          # a square
                    run = self.latest[q] = [first, past + q, q]
                    self.runs.append(run)
                    continue
            i += 1


def runs_of(texts: list[np.ndarray], exponent: int = 4, least: int = 6) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each word sequence, with ``exponent`` (3 or more) periods and ``least`` words.

    Words are numbers from 0 on. Sequences of like length share a catcher, parted by numbers that occur once.
    """
    if exponent < 3:
        raise ValueError("catchers are complete for runs of three periods and more")
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    classes: dict[int, list[int]] = defaultdict(list)
    for i, t in enumerate(texts):
        if len(t) >= max(least, exponent):
            classes[(len(t) // exponent).bit_length()].append(i)
    for levels, members in classes.items():
        at = 0
        while at < len(members):
            to, size = at, 0
            while to < len(members) and (to == at or size + len(texts[members[to]]) <= BATCH):
                size += len(texts[members[to]]) + 1
                to += 1
            part, at = members[at:to], to
            starts = np.cumsum([0, *[len(texts[i]) + 1 for i in part]])
            catcher = Catcher(max(1, levels))
            catcher.append(np.concatenate([x for k, i in enumerate(part) for x in (texts[i], np.array([-1 - k]))]))
            for first, past, q in catcher.runs:
                if past - first >= max(least, exponent * q):
                    k = int(np.searchsorted(starts, first, "right")) - 1
                    found[part[k]].append((first - int(starts[k]), past - first, q))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when every run keeps its first period only."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        depth[start + q] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def _finder(exponent: int, least: int) -> Callable[[list], list[tuple]]:
    def find(texts: list) -> list[tuple]:
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        words = [(t or "").encode().split() for t in texts]
        coded = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in words]
        out = []
        for w, runs in zip(words, runs_of(coded, exponent, least)):
            if runs:
                keep = kept_words(len(w), runs)
                w = [x for x, k in zip(w, keep) if k]
            out.append((len(keep) if runs else len(w), [{"start": a, "length": n, "period": q} for a, n, q in runs], b" ".join(w).decode()))
        return out
    return find


def find_runs(df: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """The columns of ``df`` but ``text``, with n_words, ``runs`` (by start, then period) and ``collapsed`` text.

    Words are maximal stretches without ASCII white space. A run is a stretch with smallest period q and at least
    ``max(least, exponent * q)`` words that cannot be longer. ``collapsed`` has the words that no run drops, joined
    by one blank; a run drops all words after its first q. A null or blank text has no words, no runs and an
    empty ``collapsed``. Texts of any length are taken whole; one text is the unit of memory. Rows are independent,
    so repeated rows repeat their result and an empty table gives an empty one. A column of ``df`` named like a new
    one gives way to it.
    """
    keep = [c for c in df.columns if c.lower() != "text"]
    return from_texts(df, keep, lambda: _finder(exponent, least), f"n_words bigint, runs {RUNS}, collapsed string")


def repeat_tails(df: DataFrame) -> DataFrame:
    """``df`` (doc_id, text), in which every tenth id's text ends in a repetition, a test of run detection.

    With h the crc32 of the id's text, g = h div 10: if h mod 10 = 0, the words from a = g mod n on repeat the
    first 1 + (n - a) div (3 + g mod 8) of them. Other rows, null ids and blank texts stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    blank = F.lit(" \t\n\x0b\f\r")
    df = df.select(*quoted(df.columns), F.floor(h / 10).alias("_g"), F.btrim(F.col("text"), blank).alias("_t"))
    chosen = F.coalesce((h % 10 == 0) & (F.col("_t") != ""), F.lit(False))
    words = F.split(F.when(chosen, F.col("_t")), r"[\x20\x09-\x0D]+")
    df = df.withColumn("_w", words).withColumn("_n", F.size("_w"))
    df = df.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    p = (F.lit(1) + F.floor((F.col("_n") - F.col("_a")) / (F.lit(3) + F.col("_g") % 8))).cast("int")
    df = df.withColumn("_p", p)
    times = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), times))
    edited = F.array_join(F.slice(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), F.lit(1), F.col("_n")), " ")
    return df.withColumn("text", F.when(F.col("_n") > 0, edited).otherwise(F.col("text"))).drop("_g", "_t", "_w", "_n", "_a", "_p")
