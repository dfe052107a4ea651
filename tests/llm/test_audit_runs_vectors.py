"""The filter audit, run detection and the vector join against plain Python, with their edge cases."""

import hashlib
import math
import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.cases import CLASH, TEXTS, documents, none
from visitloom.llm import audit, pigeonhole, queries, repeats

FOLDER = "/root/testdata/sf0.001"


def brute_runs(w, exponent=4, least=6):
    out = []
    for q in range(1, len(w) // exponent + 1):
        t = 0
        while t < len(w) - q:
            first = t
            while t < len(w) - q and w[t] == w[t + q]:
                t += 1
            n = t + q - first
            if n >= max(least, exponent * q) and not any(all(w[i] == w[i + p] for i in range(first, first + n - p)) for p in range(1, q)):
                out.append((first, n, q))
            t = max(t, first + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(count):
    rnd = random.Random(11)
    for _ in range(count):
        w = [rnd.randrange(rnd.choice([1, 2, 3, 50])) for _ in range(rnd.randint(0, 90))]
        while w and rnd.random() < 0.6:
            a, p = rnd.randrange(len(w)), rnd.randint(1, 12)
            for i in range(a, rnd.randint(a, len(w))):
                w[i] = w[a + (i - a) % p]
        yield np.array(w, np.int64)


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (3, 3)])
def test_runs_equal_brute_force(exponent, least):
    texts = list(sequences(800))
    got = repeats.runs_of(texts, exponent, least)
    assert got == [brute_runs(t.tolist(), exponent, least) for t in texts] and sum(map(len, got)) > 300


def test_runs_word_by_word():
    for text in sequences(60):
        whole, single = repeats.Catcher(6), repeats.Catcher(6)
        whole.append(text)
        for x in text:
            single.append(np.array([x]))
        long = lambda c: sorted(tuple(r) for r in c.runs if r[1] - r[0] >= 3 * r[2])
        assert long(whole) == long(single)


def plain_op12(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_query_equals_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter(F.length("text") < 8000).select("doc_id", "text").collect()
    want = {d.doc_id: plain_op12(d.doc_id, d.text) for d in docs}
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    out = queries.op12_run_detection(spark, FOLDER)
    got = {r.doc_id: tuple(r) for r in out.select(cols).collect()}
    assert len(want) > 100 and {i: got[i] for i in want} == want
    assert sum(r[1] > 0 for r in want.values()) >= 5 and dict(out.dtypes)["period"] == "bigint"


def test_runs_edges(spark):
    rows = repeats.find_runs(repeats.repeat_tails(documents(spark)).withColumn("runs", F.lit("user"))).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(TEXTS) and repeats.find_runs(none(spark)).count() == 0 and by[1]["dotted.name"] == "user"
    assert all((by[i].n_words, by[i].runs, by[i].collapsed) == (0, [], "") for i in (3, 4, 5))
    assert by[7].n_words == 60_000 or by[7].runs                    # the long text is taken whole
    one = spark.createDataFrame([(1, "a " * 300_000 + "b")], "doc_id long, text string")
    got = repeats.find_runs(one).first()
    assert got.runs == [(0, 300_000, 1)] and got.collapsed == "a b"
    six = repeats.find_runs(spark.createDataFrame([("x x x x x",), ("x x x x x x",)], "text string")).collect()
    assert [len(r.runs) for r in six] == [0, 1]


def plain_audit(rows, marks):
    """(part, order, step) to counts, document by document."""
    fails = []
    for i, t, lang in rows:
        t = t or ""
        w = t.encode().split()
        fails.append((lang or "", {f for f, bad in (
            ("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t)),
            ("D", any(c in t for c in "#$%&*|")),
            ("E", i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows))) if bad}, marks.get(i, (0, 0))))
    out = {}
    for part in {p for p, _, _ in fails}:
        mine = [(f, m) for p, f, m in fails if p == part]
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [m for f, m in mine if x in f and not f & before]
                out[part, order, step] = [sum(not f & (before | {x}) for f, _ in mine), len(removed), sum(x in f for f, _ in mine) - len(removed),
                                          sum(f == {x} for f, _ in mine), sum(m[0] for m in removed), sum(m[1] for m in removed)]
        total = {x: sum(out[part, o, o.index(x) + 1][1] for o in map("".join, permutations("ABCDE"))) for x in "ABCDE"}
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                out[part, order, step].append(total[x])
    return out


def test_audit_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, None), (7, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = TEXTS + [(11, "# $ lower " + "w " * 300, "de", None), (12, " ".join(f"u{i}" for i in range(250)), "", "x"), (13, None, "en", "a")]
    got = audit.audit_texts(documents(spark, rows), labels.withColumn("key", F.lit(1)))
    want = plain_audit([(i, t, lang) for i, t, lang, _ in rows], {1: (1, 1), 2: (1, 0), 7: (1, 1)})
    cols = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): [r[c] for c in cols] for r in got.collect()} == want
    assert audit.audit_texts(none(spark), labels).count() == 0
    assert {t for c, t in got.dtypes if c in cols} == {"bigint"} and dict(got.dtypes)["step"] == "int" and CLASH


def plain_links(rows, threshold=0.9):
    usable = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    width = max((len(v) for _, v in rows if v), default=0)
    x = np.array([list(v) + [0.0] * (width - len(v)) if usable(v) else [np.nan] * width for _, v in rows]).reshape(len(rows), width)
    near = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= threshold
    np.fill_diagonal(near, False)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in zip(*np.nonzero(near)):
        root[find(int(i))] = find(int(j))
    first = {}
    for k, (i, _) in enumerate(rows):       # rows of one id belong together
        if i is not None:
            root[find(first.setdefault(i, k))] = find(k)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(find(k), []).append(rows[k][0])
    name = {r: min((i for i in g if i is not None), default=None) for r, g in groups.items()}
    return sorted((str(rows[k][0]), int(near[k].sum()), name[find(k)], rows[k][0] == name[find(k)]) for k in range(len(rows)))


def vectors(dims, spread, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims)) * np.geomspace(1, 0.05, dims)
    rows = []
    for c in range(12):
        rows += [centres[c] + rng.normal(size=dims) * spread * np.linalg.norm(centres[c]) / dims ** 0.5 for _ in range(25)]
    rows += list(rng.normal(size=(150, dims)))
    rows = [[float(v) for v in r] for r in rows]
    rows += [rows[0]] * 30 + [[2.5 * v for v in rows[1]]] * 3 + [[-v for v in rows[2]]]
    rows += [None, [], [0.0] * dims, [math.nan] * dims, [math.inf] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), rows[5][: dims - 2]]
    return [(7 * k % 1009, v) for k, v in enumerate(rows)]


@pytest.mark.parametrize(("dims", "width", "tile", "spread"), [(24, 4, 16, 0.25), (10, 16, 1000, 0.3), (20, 5, 7, 0.02)])
def test_vector_links_equal_brute_force(spark, dims, width, tile, spread):
    rows = vectors(dims, spread) + [(None, vectors(dims, spread)[3][1]), (None, [1.0] * dims), (14, vectors(dims, spread)[3][1]), (14, [3.0] + [0.0] * (dims - 1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("user"))
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in pigeonhole.link_vectors(df, tile=tile, width=width).collect())
    want = plain_links(rows)
    assert got == want and sum(r[1] > 0 for r in want) > 60


def test_vector_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert pigeonhole.link_vectors(spark.createDataFrame([], schema)).collect() == []
    lone = pigeonhole.link_vectors(spark.createDataFrame([(1, None), (2, []), (None, None)], schema)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in lone) == [("1", 0, 1, True), ("2", 0, 2, True), ("None", 0, None, True)]
    # a cosine of exactly 0.9 links; a hair below it doesn't
    edge = pigeonhole.link_vectors(spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [9.0, 3.0, 3.0, 1.0]), (3, [0.0, 0.0, 0.0, 1.0]), (4, [0.0, 0.0, 0.4845, 1.0])], "vec_id long, embedding array<double>"))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in edge.collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4)]


def test_cells_keep_every_pair_in_budget():
    """Points within a block's budget always meet: their cells are near each other."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 6)) * np.array([3, 1, 1, 0.5, 0.2, 0.1])
    cells = pigeonhole._plant(x, 6)
    y = x + rng.normal(size=x.shape) * 0.15
    budget = 0.3
    near = [set(c.tolist()) for c in cells.near(budget, 6)]
    inside = ((x - y) ** 2).sum(1) <= budget
    a, b = cells.home(x), cells.home(y)
    assert inside.sum() > 1000 and all(max(i, j) in near[min(i, j)] for i, j in zip(a[inside], b[inside]))
    assert sum(map(len, near)) < 64 * 63 / 2
