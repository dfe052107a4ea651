"""Words of whole texts as 64-bit hashes, straight from Arrow's UTF-8 buffers.

Words are runs of digits, letters a-z (A-Z lower-cased) and all characters above U+007F. Every byte
of such a character is above 0x7F, so the split works on bytes. Hashes are polynomial in the bytes,
modulo 2^64, then mixed; a word's hash does not depend on where it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

SLICE = 1 << 20                # bytes worked on at once
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... modulo 2^64; kept for the largest length so far (bounded by the longest word slice)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 2 * SLICE), base, np.uint64)
        step[0] = 1
        have = _powers[base] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_slice(b: np.ndarray, is_word: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first and past-the-end byte of each word; no word crosses one of the cuts."""
    before = np.empty_like(is_word)
    before[0], before[1:] = False, is_word[:-1]
    before[cuts[cuts < len(b)]] = False
    first = np.flatnonzero(is_word & ~before)
    after = np.empty_like(is_word)
    after[-1], after[:-1] = False, is_word[1:]
    ends = cuts[(cuts > 0) & (cuts <= len(b))] - 1
    after[ends] = False
    past = np.flatnonzero(is_word & ~after) + 1
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(b)), out=total[1:])
    raw = (total[past] - total[first]) * _power(INVERSE, len(b))[first]
    return mix(raw + (past - first).astype(np.uint64)), first, past


def hashed(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (first row, past row, hashes, words per row, first byte, past byte) for runs of rows.

    A run holds about SLICE bytes, or one longer text. Bytes count from the run's own start.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + n + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        j = min(j, n)
        raw = data[offsets[i]: offsets[j]]
        cuts = offsets[i: j + 1] - offsets[i]
        if len(raw) == 0:
            z = np.zeros(0, np.int64)
            yield i, j, z.astype(np.uint64), np.zeros(j - i, np.int64), z, z
        else:
            parts, at = [], 0
            while at < len(raw):
                to = min(len(raw), at + 2 * SLICE)
                while True:            # a long text is cut between words
                    b = LOWER[raw[at:to]]
                    w = IS_WORD[b]
                    if to == len(raw) or not w[-1]:
                        break
                    last = len(w) - int(np.argmin(w[::-1])) if not w.all() else 0
                    if last:
                        to = at + last
                        b, w = b[:last], w[:last]
                        break
                    to = min(len(raw), to + 2 * SLICE)   # one word longer than the slice
                h, s, e = _hash_slice(b, w, cuts[(cuts >= at) & (cuts <= to)] - at)
                parts.append((h, s + at, e + at))
                at = to
            h, s, e = (np.concatenate(x) for x in zip(*parts))
            counts = np.diff(np.searchsorted(s, cuts, "left"))
            yield i, j, h, counts, s, e
        i = j


def grams(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of the k words from each position; the last k - 1 positions have none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt * 0x632BE59BD9B4E019 % (1 << 64), np.uint64)
    c = 1
    for j in range(k):
        c = c * 0xD1342543DE82EF95 % (1 << 64)
        out += h[j: j + n] * np.uint64(c)
    return mix(out)
