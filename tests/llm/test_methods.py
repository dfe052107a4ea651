"""Operators against brute force, the tokenizer library, or held-out labels, on the smallest tables."""

import collections
import random

import public_tokenizers
import pytest
import sentencepiece
from compare import compare, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry
from llm.cases import words
from visitloom.llm import imatch, jaccard, licenses, toxicity
from visitloom.llm.queries import RUN, SQL
from visitloom.llm.tokens import Transducer, escaped

FOLDER = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    assert compare(RUN[name](spark, FOLDER), duck(FOLDER), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(RUN))
def test_registered(spark, name):
    df = entry.queries()[name](spark, FOLDER)
    if name.startswith("op11"):
        assert df.count() == 600 * spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.coalesce("lang", F.lit(""))).distinct().count()
        return
    table = {"op6": "pages", "op13": "embeddings"}.get(name.split("_")[0], "documents")
    assert df.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def brute_links(rows, threshold=0.8):
    """class and links by comparing all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        w = words(t)
        if w:
            sets[i] = {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))}
    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    links, root = collections.Counter(), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, s in sets.items():
        shared = collections.Counter(j for x in s for j in where[x] if j > i)
        for j, n in shared.items():
            if n >= threshold * (len(s) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i, _ in rows}


def test_jaccard_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.link_documents(docs).collect()}
    assert got == brute_links([(r.doc_id, r.text) for r in docs.collect()])


def test_jaccard_large_groups_and_chains(spark, monkeypatch):
    """A chain of texts each similar to the next only, and a group that spans several blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", 16)
    rng = random.Random(3)
    chain = [f"w{n}" for n in range(400)]
    rows = [(n, " ".join(chain[12 * n: 12 * n + 200])) for n in range(17)]
    base = [f"b{n}" for n in range(300)]
    for n in range(120):
        t = list(base)
        t[rng.randrange(300)] = f"x{n}"
        rows.append((100 + n, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.link_documents(df).collect()}
    assert got == brute_links(rows)


def test_pruning_table():
    least = jaccard.least_matches(0.8, 1e-6, range(16, 97, 16))
    assert all(0 < least[n] < 0.8 * n for n in least) and least[96] > least[16]


def test_transducer_equals_the_library():
    library, mine, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), Transducer(MODEL), random.Random(1)
    letters = "aaabbeeettthhh  ..,\n\n\t-=*#▁<s>0x0A>日本語éß😀 \x00\r}{();"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        want = len(library.encode(text))
        assert mine.count(escaped(text)) == want, text
        cut, marked = rng.randint(1, 6), escaped(text)
        parts = [mine.map(marked[i: i + cut]) for i in range(0, len(marked), cut)]
        assert not parts or mine.total(parts) == want, text


def test_patience_alignment():
    a, b = "x a b c d y a e f z".split(), "a b c q d a e f".split()
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == 7
    assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))


def test_license_texts_with_gaps():
    scan = licenses.Scanner(licenses.TEMPLATES, licenses.MIN_COVERAGE).scan
    mit = licenses.TEMPLATES["MIT-text"]
    changed = "intro " + mit.replace("free of charge", "gratis").replace("merge, ", "") + " outro"
    (name, coverage, start, past), = scan(changed)
    assert name == "MIT-text" and 0.9 < coverage < 1 and changed[start:past].startswith("Permission is hereby")
    assert [m[0] for m in scan(f"{mit} some other words in between here now {mit}")] == ["MIT-text"] * 2
    assert scan("the license of the software is not a notice") == []


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_license_templates_find_themselves(name):
    scan, text = licenses.Scanner(licenses.TEMPLATES, licenses.MIN_COVERAGE).scan, licenses.TEMPLATES[name]
    for between in (" ", " and ", " some other words in between here now "):
        for n in (1, 2, 5):
            assert [m[:2] for m in scan(between.join([text] * n))] == [(name, 1.0)] * n


def test_license_opening_words_inside():
    scan = licenses.Scanner({"x": "a b c d a b e f a b g h"}, 0.8).scan
    assert [m[1] for m in scan("a b c d a b e f a b g h a b c d a b z f a b g h")] == [1.0, 11 / 12]
    gpl = licenses.TEMPLATES["GPL-3.0-header"]
    changed = gpl.replace("free software", "software").replace("hope that", "hope this program")
    assert [m[0] for m in licenses.Scanner(licenses.TEMPLATES, 0.8).scan(f"{changed} {gpl} {changed}")] == ["GPL-3.0-header"] * 3


def test_toxicity_learns_marks():
    rng = random.Random(5)
    plain = [f"w{n}" for n in range(300)]

    def text(marks):
        t = [rng.choice(plain) for _ in range(60)]
        for m in marks:
            t[rng.randrange(60)] = m
        return " ".join(t) + "."
    marks = ["grub", "snark", "blorfed", "blorfing", "blorfy"]
    rows = [(text([rng.choice(marks)]), 1) for _ in range(200)] + [(text([]), 0) for _ in range(600)]
    model = toxicity.train(rows, 0.1)
    score = lambda t: toxicity.final_score(model, *toxicity.score_texts(model, [t])[0][:2])
    assert all(score(text([m])) > 0.3 for m in [*marks, "blorfness"]) and score("") < 0.1
    assert sum(score(text([])) >= 0.3 for _ in range(200)) == 0
    sample = text(["grub"])
    (start, past, _), = toxicity.score_texts(model, [sample])[0][2]
    assert sample[start:past] == "grub"


def test_toxicity_samples_long_texts_in_pieces(spark, monkeypatch):
    for name, value in (("SAMPLE_CHARS", 100_000), ("DOC_CHARS", 2000)):
        monkeypatch.setattr(toxicity, name, value)
    rows = [(i, "word and other " * (10_000 if i % 3 == 0 else 20)) for i in range(120)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    got = toxicity.sample(spark.createDataFrame(rows, "doc_id long, text string"), marks)
    assert len(got) > 60 and {t for _, t in got} == {0, 1} and 1900 < max(len(t) for t, _ in got) < 2100


def test_toxicity_learns_without_punctuation():
    rng = random.Random(5)
    plain = [f"w{n}" for n in range(300)]
    text = lambda *marks: " ".join(rng.sample([*marks, *rng.choices(plain, k=200)], 200 + len(marks)))
    model = toxicity.train([(text("grub", "snark"), 1) for _ in range(200)] + [(text(), 0) for _ in range(600)], 0.1)
    score = lambda t: toxicity.final_score(model, *toxicity.score_texts(model, [t])[0][:2])
    assert score(text("grub", "snark")) > 0.3 and score(text()) < 0.1


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = RUN["op7_language"](spark, folder).filter("held_out").select("doc_id", "lang_pred").join(
        spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    marks = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic")
    rows = RUN["op4_toxicity"](spark, folder).filter("held_out").select("doc_id", "predicted").join(marks, "doc_id").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(toxic) / len(toxic) > 0.9 and sum(clean) / len(clean) < 0.02


def test_imatch_separates(spark):
    r = RUN["op10_imatch"](spark, FOLDER).agg({"near_edited": "avg", "near_next": "avg"}).first()
    assert r["avg(near_edited)"] > 3 * r["avg(near_next)"]


def test_imatch_near_copies_of_a_third(spark):
    """A text whose near copies are a third of the rows, and texts of terms that no other has, keep a gradual likeness."""
    rng = random.Random(9)
    base, words = [f"b{n}" for n in range(80)], [f"w{n}" for n in range(3000)]
    rows = []
    for i in range(0, 900, 3):
        near = list(base)
        near[rng.randrange(80)] = f"w{rng.randrange(3000)}"
        rows += [(i, " ".join(near)), (i + 1, " ".join(rng.sample(words, 80))), (i + 2, " ".join(f"r{i}x{n}" for n in range(80)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = imatch.edited_likeness(df).groupBy((F.col("doc_id") % 3).alias("k")).agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).collect()
    assert len(got) == 3 and all(0.1 < r.e < 0.7 and r.n < 0.05 for r in got), got
    copied = df.unionByName(df.filter("doc_id = 2").crossJoin(spark.range(500)).select("doc_id", "text"))
    assert sorted(imatch.lexicon(copied).collect()) == sorted(imatch.lexicon(df).collect())


def test_imatch_hashes_every_kept_term(spark, monkeypatch):
    """Any one term changes the fingerprint; order and repetition do not; a shuffled lexicon gives the same."""
    base = [f"t{n}" for n in range(40)]
    texts = [" ".join(base), " ".join(reversed(base)) + " T3, t4"] + [" ".join(base[:i] + [f"new{i}"] + base[i + 1:]) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for known in ([], base):
        words = spark.createDataFrame([(w,) for w in known], "w string").select(F.xxhash64("w").alias("term"))
        got = imatch.fingerprints(df, words, ["doc_id"], "text")
        prints = {r.doc_id: bytes(r.text_print) for r in got.collect()}
        assert prints[0] == prints[1] and len(set(prints.values())) == 41
        own = F.lit(bytearray(prints[0]))
        near = {r.doc_id: r.near for r in got.select("doc_id", imatch.likeness(F.col("text_print"), own).alias("near")).collect()}
        # one term less and one more differ in one or two of at most 32 hashes
        assert near[0] == near[1] == 1.0 and all(0.85 <= near[i] < 1 for i in range(2, 42)), near
        with monkeypatch.context() as m:
            m.setattr(imatch, "BROADCAST_TERMS", -1)
            shuffled = {r.doc_id: bytes(r.text_print) for r in imatch.fingerprints(df, words, ["doc_id"], "text").collect()}
        assert shuffled == prints
