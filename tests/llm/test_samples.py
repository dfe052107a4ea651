"""Fitting samples that repeated rows cannot displace, notices with foreign words inside, offsets beside long lower cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from visitloom.llm import language, licenses, toxicity
from visitloom.llm.common import folded, held_out

VOCAB = [f"word{i}" for i in range(400)]


def prose(rnd, extra=()):
    w = [rnd.choice(VOCAB) for _ in range(60)]
    for x in extra:
        w[rnd.randrange(60)] = x
    return " ".join(w) + "."


def test_repeated_id_does_not_fill_the_toxicity_sample(spark):
    rnd = random.Random(1)
    rows = [(i, prose(rnd, ["vileword", "hatefulterm"] if i % 5 == 0 else ())) for i in range(1000)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(1000)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = labels.filter(~held_out() & (F.col("toxic") == 0)).orderBy(F.xxhash64(F.lit("crf"), "doc_id")).first().doc_id
    many = docs.unionByName(docs.filter(F.col("doc_id") == first).crossJoin(spark.range(5000)).select("doc_id", "text"))
    many = many.unionByName(spark.range(3000).select(F.lit(first).alias("doc_id"), F.concat(F.lit("other text "), "id").alias("text")))
    drawn = toxicity.sample(many, labels)
    assert sum(y for _, y in drawn) > 100 and len(drawn) <= 1000
    scored = toxicity.tag(docs, toxicity.fit(many, labels))
    found = scored.filter("doc_id % 5 = 0").filter(F.col("tox_score") >= toxicity.THRESHOLD).count()
    wrong = scored.filter("doc_id % 5 <> 0").filter(F.col("tox_score") >= toxicity.THRESHOLD).count()
    assert found == 200 and wrong == 0


def test_long_texts_leave_room_for_others(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 30_000)
    docs = spark.createDataFrame([(i, ("long " * 5000) if i % 2 else "short text") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    assert sum(y for _, y in toxicity.sample(docs, labels)) >= 10


def test_repeated_rows_do_not_drop_a_language(spark):
    rnd = random.Random(2)
    rows = [(1, "aaba abba baab abab", "aa")] * 2000 + [(10 + i, " ".join(rnd.choice(["zyzzy", "zuzu", "quzz", "zqzq"]) for _ in range(20)), "zz") for i in range(400)]
    rows += [(5000 + i, "same lone text of a third language, kkkk kokoko", "kk") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language.fit(docs)
    assert set(learned) == {"aa", "kk", "zz"} and len(learned["zz"]) > 5000
    got = language.predict(spark.createDataFrame([(1, "zuzu zyzzy quzz"), (2, "lone text of a third language, kkkk kokoko"), (3, None)], "doc_id long, text string"), learned)
    assert {r.doc_id: r.lang_pred for r in got.collect()} == {1: "zz", 2: "kk", 3: "und"}
    empty = docs.filter("doc_id < 0")
    assert language.predict(empty, language.fit(empty)).count() == 0


@pytest.mark.parametrize("name", ["MIT-text", "GPL-3.0-header", "BSD-3-Clause-text"])
@pytest.mark.parametrize("foreign", [10, 100, 1000])
def test_notice_with_foreign_words_inside(name, foreign):
    name = next((n for n in licenses.TEMPLATES if n.startswith(name.split("-")[0]) and len(licenses.TEMPLATES[n]) > 200))
    template = licenses.TEMPLATES[name].split(" ")
    half = len(template) // 2
    text = "before " + " ".join([*template[:half], *(f"xq{i}" for i in range(foreign)), *template[half:]]) + " after"
    found = licenses.Scanner(licenses.TEMPLATES, 0.8).scan(text)
    assert [f[0] for f in found] == [name] and found[0][1] == 1.0
    assert text[found[0][2]: found[0][3]].startswith(template[0]) and text[: found[0][3]].endswith(template[-1].rstrip('."'))


def test_many_notices_take_seconds():
    text = "All rights reserved. nothing to see between these two notices at all, really.\n" * 100_000
    start = time.time()
    found = licenses.Scanner(licenses.TEMPLATES, 0.8).scan(text)
    assert len(found) == 100_000 and time.time() - start < 60


def test_plain_prose_has_no_notice():
    rnd = random.Random(3)
    words = sorted({w for t in licenses.TEMPLATES.values() for w in licenses.words(t)}) + VOCAB * 3
    text = " ".join(rnd.choice(words) for _ in range(20_000))
    assert all(f[1] < 1 or len(licenses.TEMPLATES[f[0]].split()) < 5 for f in licenses.Scanner(licenses.TEMPLATES, 0.8).scan(text))


def test_offsets_stand_beside_long_lower_cases(spark):
    assert folded(toxicity.TOKEN, "İa Bc.") == ["i̇a", "bc", "."]
    text = "İİİ All rights reserved İ"
    name, _, s, e = licenses.Scanner(licenses.TEMPLATES, 0.8).scan(text)[0]
    assert text[s:e] == "All rights reserved" and name
    rnd = random.Random(5)
    docs = spark.createDataFrame([(i, prose(rnd, ["vileword"] * 3 if i % 4 == 0 else ())) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    text = "İstanbul word1 word2 vileword word3"
    spans = toxicity.score_texts(model, [text])[0][2]
    assert spans and all(0 <= a < b for a, b, _ in spans) and any("vileword" in text[a:b] for a, b, _ in spans)
