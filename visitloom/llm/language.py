"""Identify languages by compression with one dictionary per language.

Each language has a raw-content zstandard dictionary of sampled text. A text is lower-cased and compressed
with each, in short pieces, so that a long text cannot become its own dictionary; all pieces count.
The language with the smallest total wins. A text is ``rejected`` if the runner-up needs less than
MARGIN more bytes per byte of text; the best guess is given all the same.

Defined cases: a text that is null or has no letter is ``und`` with score 0. Ties go to the first language
by name. Very long texts are taken whole; an empty table gives an empty result. Rows without lang are not learned from. Without any learned language all is ``und``. Repeated ids
are judged row by row. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import from_texts, held_out, pieces, uniform

SAMPLE_DOCS = 120              # expected documents sampled per language
PER_DOC, PIECES = 2048, 4      # characters one sampled document gives to a dictionary, from so many random places
DICTIONARY = 112 << 10         # bytes of a dictionary
MAX_LANGUAGES = 500            # a table with more is refused, as each text is compressed once per language
PIECE = 512
LEVEL = 11
MARGIN = 0.005
SCALE = 300.0                  # bytes saved per byte of text to log-odds
ROUND = 1 << 20                # bytes of texts compressed with one dictionary before the next one's turn


def fit(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries by language, from a bounded random sample of the rows that may be learned from."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    known = known.withColumn("h", F.xxhash64("text"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return {}
    # different texts are drawn, so repeated rows take no place; a language of few texts gives all of them
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, SAMPLE_DOCS / max(r["texts"], 1)) if r["texts"] > 2 * SAMPLE_DOCS else 1.0) for r in counts], "_lang string, rate double")
    picked = (known.select("lang", "text", "h").join(F.broadcast(rates), F.col("lang") == F.col("_lang"))
              .withColumn("u", uniform(F.col("h"), "lang")).filter(F.col("u") < F.col("rate"))
              .select("lang", "u", "h", pieces(F.col("text"), F.col("h"), PER_DOC, PIECES).alias("text"))
              .groupBy("lang", "u", "h").agg(F.min("text").alias("text")).orderBy("lang", "u", "h"))
    found: dict[str, bytes] = {}
    seen: set[str] = set()
    for r in picked.toLocalIterator():
        text = r["text"].lower()
        if text not in seen and len(found.get(r["lang"], b"")) < DICTIONARY:
            seen.add(text)
            found[r["lang"]] = (found.get(r["lang"], b"") + text.encode() + b"\n")[:DICTIONARY]
    return dict(sorted(found.items()))


class Coder:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.names = list(dictionaries)
        self.coders = []
        for data in dictionaries.values():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False))

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the margin is too narrow."""
        return self.judge_all([text])[0]

    def judge_all(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """``judge`` of every text. A dictionary's tables fill a processor's cache, so each takes its turn over
        ROUND bytes of texts rather than over every text."""
        out, data, places, held = [("und", 0.0, True)] * len(texts), [], [], 0
        for i, text in enumerate(texts):
            if not text or not self.names or not any(map(str.isalpha, text)):
                continue
            data.append(text.lower().encode())
            places.append(i)
            held += len(data[-1])
            if held >= ROUND:
                self._round(data, places, out)
                data, places, held = [], [], 0
        self._round(data, places, out)
        return out

    def _round(self, data: list[bytes], places: list[int], out: list[tuple[str, float, bool]]) -> None:
        by_language = [[sum(len(c.compress(d[i: i + PIECE])) for i in range(0, len(d), PIECE)) for d in data] for c in self.coders]
        for d, place, sizes in zip(data, places, np.array(by_language, float).T):
            best = int(sizes.argmin())
            saved = (np.delete(sizes, best).min() - sizes[best]) / len(d) if len(sizes) > 1 else 1.0
            weights = np.exp(-np.minimum((sizes - sizes[best]) / len(d) * SCALE, 700))
            out[place] = self.names[best], float(1 / weights.sum()), bool(saved < MARGIN)


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)      # at most MAX_LANGUAGES x DICTIONARY bytes

    def make():
        return Coder(shared.value).judge_all
    marked = docs.select("doc_id", held_out().alias("held_out"), "text")
    return from_texts(marked, ["doc_id", "held_out"], make, "lang_pred string, score double, rejected boolean")
