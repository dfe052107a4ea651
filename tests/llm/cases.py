"""Small documents with the cases every operator must define, and plain-Python forms of what is computed."""

import re

from pyspark.sql import functions as F

BENCH = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
LONG = " ".join(f"w{i % 4001}x{i % 13}" for i in range(60_000))          # about 400,000 characters
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.\nShared footer line", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.\nShared footer line", "en", "b"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.\nShared footer line", "en", "b"),
    (3, None, "en", "a"),
    (4, "", None, None),
    (5, " \n\t ", "de", "c"),
    (6, "one", "fr", "c"),
    (7, LONG, "en", "d"),
    (8, f"before it {BENCH} and after it\nShared footer line", "en", "d"),
    (9, "ÄÖÜ ünïcödé 日本語 😀 tie tie tie", None, "é"),
    (None, "a row without an id\nShared footer line", "en", "e"),
    (10, "Licensed under the Apache License, Version 2.0.\n\n  Shared footer line ", "en", "f"),
]
# names that operators use inside
CLASH = ["row", "key", "size", "hash", "target", "term", "tox_score", "n_removed", "_row", "_text", "label", "u", "dotted.name"]
SCHEMA = "doc_id long, text string, lang string, source string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def documents(spark, rows=TEXTS):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({f"`{c}`" if "." in c else c: F.lit(f"user {c}") for c in CLASH if "." not in c}).withColumn("dotted.name", F.lit("user"))


def none(spark):
    return documents(spark, [])


def words(text):
    return WORD.findall((text or "").translate(LOW))
