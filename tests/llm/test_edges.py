"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import math

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from llm.cases import BENCH, LONG, TEXTS, documents, none, words
from visitloom.llm import decontaminate, imatch, jaccard, language, licenses, lines, mixing, tokens, toxicity, urls

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def labels(spark, rows=((1, 1, 0), (2, 1, 0), (6, None, 1), (None, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def benchmark(spark, rows=((1, BENCH), (2, "lazy dog"), (2, "lazy dog"), (3, None), (4, ""), (5, "not there at all"))):
    return spark.createDataFrame(list(rows), "item_id long, text string").withColumn("row", F.lit("user"))


def test_mixing(spark):
    rows = mixing.mix(documents(spark)).collect()
    assert len(rows) == len(TEXTS) and mixing.mix(none(spark)).count() == 0
    total = sum(len((t or "").split()) for _, t, _, _ in TEXTS)
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(1.5 * total)
    for r in rows:
        assert r.taken == r.copies * r.size and r.taken <= 2 * r.size and r.target <= 2 * r.source_size + 1e-9
    assert rows == mixing.mix(documents(spark)).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mix(documents(spark)).collect()))


def test_licenses(spark):
    rows = licenses.scan_licenses(documents(spark)).collect()
    got = {r.doc_id: (r.n_notices, r.license, r.coverage) for r in rows}
    assert len(rows) == len(TEXTS) and licenses.scan_licenses(none(spark)).count() == 0
    assert got[10] == (1, "Apache-2.0", 1.0) and got[3] == got[4] == got[7] == (0, None, 0.0)


def test_jaccard(spark):
    rows = jaccard.link_documents(documents(spark)).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id, r.n_links) for r in rows)
    assert got[:6] == [(-1, None, 0), (1, 1, 2), (2, 1, 2), (2, 1, 2), (3, 3, 0), (4, 4, 0)] and len(rows) == len(TEXTS)
    assert jaccard.link_documents(none(spark)).count() == 0


def test_toxicity(spark):
    docs, empty = documents(spark), none(spark)
    model = toxicity.fit(docs, labels(spark))
    rows = toxicity.tag(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.tox_score <= 1 for r in rows) and rows[0]["dotted.name"] == "user"
    assert toxicity.tag(empty, toxicity.fit(empty, labels(spark))).count() == 0
    assert toxicity.fit(docs, labels(spark, [])).curve == toxicity.fit(empty, labels(spark)).curve


def test_lines(spark):
    rows = lines.strip_lines(documents(spark), min_sites=4).collect()
    footers = [(r.doc_id, r.n_removed, r.text) for r in rows if "Shared footer line" in (r.text or "")]
    # the smallest id, null before all others, keeps it; a null source counts for no site
    assert [f[0] for f in footers] == [None] and len(rows) == len(TEXTS)
    by = {r.doc_id: r for r in rows}
    assert by[10].text == "Licensed under the Apache License, Version 2.0.\n" and (by[10].n_lines, by[10].n_removed) == (3, 1)
    assert by[3].text is None and by[3].n_lines == 0 and by[4].text == "" and by[7].text == LONG and by[1]["dotted.name"] == "user"
    assert lines.strip_lines(none(spark)).count() == 0
    assert all(r.n_removed == 0 for r in lines.strip_lines(documents(spark), min_sites=9).collect())


@pytest.mark.parametrize("min_sites", [2, 3, 5, 40, 60])
def test_lines_near_the_threshold(spark, min_sites):
    """Every spread around the threshold, exactly: sketches only decide far from it."""
    rows = [(s * 100 + n, f"line on {n} sites", "en", f"s{s}") for n in range(1, 80) for s in range(n)]
    got = lines.strip_lines(documents(spark, rows), min_sites).filter("n_removed > 0").select("doc_id").collect()
    assert {r.doc_id for r in got} == {s * 100 + n for n in range(min_sites, 80) for s in range(1, n)}


def test_urls(spark):
    pages = [(1, "http://A.Example.org/es/1"), (2, "https://example.org/en/1?x"), (3, "x://example.org/en/2"), (4, "http://b.com/fr/1"),
             (5, "http://com/de/"), (6, "http://notcom.net/de/1"), (7, None), (8, "no scheme"), (9, ""), (10, "http://"), (11, "http://org"),
             (12, "http://b.com/de#x"), (13, "a://b://c/d"), (13, "a://b://c/d"), (None, "http://ÄB.org/É"), (14, "http://x.com//fr/")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("host", F.lit("user"))
    marks = spark.createDataFrame([(6, 1), (None, 1), (7, None)], "page_id long, bad int")
    rows = urls.judge(df, marks).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(pages)
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block") and got[2] == ("example.org", "/en/1", "example.org/en/1", "block")
    assert got[3][2:] == ("org/", "allow") and got[4][2:] == ("com/fr/", "allow") and got[5] == ("com", "/de/", "com/de/", "block")
    assert got[6][2] is None and got[7][:3] == got[8][:3] == got[9][:3] == got[10][:3] == ("", "", None)
    assert got[11][:3] == ("org", "", None) and got[12][:3] == ("b.com", "/de", None) and got[13][:2] == ("b:", "//c/d")
    assert got[None][:3] == ("Äb.org".replace("Ä", "Ä"), "/É", "org/") and got[14][2] is None
    assert urls.judge(df.limit(0), marks).count() == 0


def test_url_templates_follow_the_labels(spark):
    pages = [(i, f"http://h.net/{'bad' if i % 2 else ('good' if i % 4 else 'fine')}/{i}") for i in range(400)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(400)], "page_id long, bad int")
    rows = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), marks).collect()
    assert {r.template for r in rows} == {"/bad/{digits}", "/(fine|good)/{digits}"}
    assert all((r.verdict == "block") == (r.page_id % 2 == 1) for r in rows)


def test_url_sections_below_the_share_and_deep_ones(spark):
    pages = [(i, f"http://h.net/s{chr(97 + i % 100 // 10)}{chr(97 + i % 10)}/page{i}") for i in range(4000)]
    pages += [(i, f"http://d.net/a/b/c/d/e/f/{'bad' if i % 2 else 'good'}/{i}") for i in range(4000, 4200)]
    marks = spark.createDataFrame([(i, int(i % 100 < 5 if i < 4000 else i % 2)) for i in range(4200)], "page_id long, bad int")
    rows = urls.judge(spark.createDataFrame(pages, "page_id long, url string"), marks).collect()
    assert all((r.verdict == "block") == (r.page_id % 100 < 5 if r.page_id < 4000 else r.page_id % 2 == 1) for r in rows)
    assert len({r.template for r in rows}) == 4


def test_language(spark):
    docs = documents(spark)
    rows = language.predict(docs, language.fit(docs)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(TEXTS) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5))
    assert all(r.lang_pred in ("en", "de", "fr", "und") and 0 <= r.score <= 1 for r in rows)
    assert language.predict(none(spark), language.fit(none(spark))).count() == 0
    assert {r.lang_pred for r in language.predict(docs, {}).collect()} == {"und"}


def test_language_dictionaries_take_turns_over_many_texts(monkeypatch):
    coder = language.Coder({"aa": b"alpha beta gamma " * 50, "bb": b"uno dos tres cuatro " * 50})
    texts = ["alpha beta gamma alpha", None, "uno dos tres cuatro uno", "", "12", "gamma alpha beta " * 100, "tres cuatro uno"]
    alone = [coder.judge(t) for t in texts]
    turns = []

    class Noted:
        def __init__(self, name, inner):
            self.name, self.inner = name, inner

        def compress(self, data):
            turns.append(self.name)
            return self.inner.compress(data)
    coder.coders = [Noted(n, c) for n, c in zip(coder.names, coder.coders)]
    assert coder.judge_all(texts) == alone
    assert [a[0] for a in alone] == ["aa", "und", "bb", "und", "und", "aa", "bb"]
    assert sum(a != b for a, b in zip(turns, turns[1:])) == 1          # each dictionary once, not once a text
    monkeypatch.setattr(language, "ROUND", 12)
    assert coder.judge_all(texts) == alone


def test_decontamination(spark):
    docs = documents(spark)
    rows = {r.doc_id: r for r in decontaminate.report(docs, benchmark(spark)).collect()}
    assert decontaminate.report(docs, benchmark(spark)).count() == len(TEXTS) and rows[8].n_hit == 15 and rows[8].n_items == 1
    assert rows[1].n_hit == 2 and rows[1].items_sha256 == hashlib.sha256(b"2").hexdigest()
    assert rows[7].n_words == 60_000 and not rows[7].contaminated and rows[3].n_words == 0
    assert rows[3].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert not any(r.contaminated for r in decontaminate.report(docs, benchmark(spark, [])).collect())
    assert decontaminate.report(none(spark), benchmark(spark)).count() == 0


def test_tokens(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(library.encode(t or ""))) for i, t, _, _ in TEXTS)
    for chunk in (tokens.CHUNK, 7, 1):
        rows = TEXTS if chunk > 10 else [r for r in TEXTS if len(r[1] or "") < 1000]
        got = tokens.count_tokens(documents(spark, rows), MODEL, chunk).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == [w for w in want if w[1] < 1000 or chunk > 10]
    assert tokens.count_tokens(none(spark), MODEL).count() == 0


def test_imatch(spark):
    rows = imatch.edited_likeness(documents(spark)).collect()
    assert len(rows) == len(TEXTS) and imatch.edited_likeness(none(spark)).count() == 0
    # ascending id, null last; equal rows follow each other; the last is followed by the first
    order = sorted(TEXTS, key=lambda r: math.inf if r[0] is None else r[0])
    want = []
    for n, (i, text, _, _) in enumerate(order):
        t, after = text or "", order[(n + 1) % len(order)][1] or ""
        q = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=str) == sorted(want, key=str)
    prints = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(next(t or "" for i, t, _, _ in TEXTS if i == r.doc_id), set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len({p for s in prints.values() for p in s}) == len(prints) - 1   # "" and blanks have no term


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("edges"))
    documents(spark).write.parquet(f"{d}/documents.parquet")
    labels(spark).write.parquet(f"{d}/labels.parquet")
    benchmark(spark).write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        out = stage(spark, docs, folder)
        rows = out.collect()
        if name != "mixing":
            assert out.columns == docs.columns and all(r["n_removed"] == "user n_removed" and r["tox_score"] == "user tox_score" for r in rows)
        assert stage(spark, docs.limit(0), folder).count() == 0
        if name == "benchmark_decontamination":
            assert {r.doc_id for r in rows} == {3, 4, 5, 6, 7, 9, 10, None}
        if name == "ngram_jaccard_join":
            assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 8, 9, 10] and len(rows) == 10
    assert words("A-b É1") == ["a", "b", "É1"]
