"""Tag toxic spans with a linear-chain conditional random field and score documents.

Training. The labels are per document, so tokens are labelled first, on a bounded sample of labelled
documents: a word, or the beginning of one (some languages inflect), marks toxic text if most of the
sampled documents that have it, or of its uses in them, are toxic; near copies count once. Its tokens in
toxic documents get tag 1, all others tag 0. Of a document over DOC_CHARS, pieces from random places are sampled, so that no
document displaces others. A chain with two tags is then fitted to sentences of the sample: features are the word, its
first four and five letters and the words before and after; transitions are learned; Adam on the exact
gradient from forward-backward.

Scoring. Every whole text is cut into sentences, and forward-backward gives each token's marginal. Runs of
tokens above a floor are spans. The sum of -log(1 - peak) over a document's spans is its evidence; a
logistic curve over the evidence and the logarithm of the document's words, fitted on the sample at the labels'
own ratio, gives the score.

Defined cases: null and empty texts have no span and get the curve's lowest score. Repeated ids are
scored row by row. Labels that are null are ignored, conflicting labels of an id count as toxic. Without labels of both kinds
everything gets the score of no evidence, near 0. Inputs of a score are the text alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import folded, from_texts, held_out, pieces
from visitloom.llm.words import grams, mix

SAMPLE_TOXIC, SAMPLE_CLEAN = 800, 2600       # labelled documents a model is fitted on, at most
SAMPLE_CHARS = 10_000_000                     # and their characters; further sampled documents are left out
DOC_CHARS, PIECES = 20_000, 20                # of a longer document, so many characters from so many random places
SENTENCE = 80                                 # words; a longer sentence is learned from in parts
MIN_DOCS = 5                                  # a word in fewer sampled documents is not learned
USES = 4                                      # of a word in one document that count as signs
PURE = 0.6                                    # held-down toxic share from which a word marks toxic text
FLOOR = 0.1                                   # of a token's marginal inside a span
MOST = 30.0                                   # evidence is not counted beyond this
THRESHOLD = 0.3
TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
STOPS = frozenset(".!?\n")
SEEN = 500_000                                # words whose scores a worker keeps
RUN_CHARS = 1_000_000                         # of texts scored together
GROUP_TOKENS = 200_000                        # scored at once


@dataclass
class Model:
    """Emission score of tag 1 minus tag 0 per feature, start and transition scores, the curve.

    Feature 0 stands for every unknown word or beginning, 1 for the place beyond a sentence.
    """

    ids: dict[str, int]
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    start: np.ndarray
    move: np.ndarray
    bias: float
    curve: tuple[float, float, float]
    index: dict[str, int] = field(default_factory=dict, repr=False)
    tables: tuple = field(default=(), repr=False)

    def look(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word whether it ends a sentence, its id, and the score of its own features."""
        if not self.tables or len(self.index) > SEEN:
            self.index = {w: 0 for w in STOPS}
            self.tables = np.zeros(1, np.int64), np.zeros(1)
        ids, own = [], []
        at = list(map(self.index.get, words))
        if None in at:
            for n, i in enumerate(at):
                if i is None:
                    w = words[n]
                    i = self.index.get(w)
                    if i is None:
                        i = self.index[w] = len(self.tables[0]) + len(ids)
                        found = [self.ids.get(f, 0) for f in features(w)]
                        ids.append(found[0])
                        own.append(float(self.own[found].sum()) + self.bias)
                    at[n] = i
        if ids:
            self.tables = np.append(self.tables[0], ids), np.append(self.tables[1], own)
        at = np.array(at, np.int64)
        return at == 0, self.tables[0][at], self.tables[1][at]


def features(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" if len(word) >= n else "" for n in (4, 5))]


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """(text, toxic) of a bounded random sample of the labelled documents that may be learned from.

    The labelled ids that ``docs`` has are drawn, each class by itself, and an id gives one of its texts (the one of
    smallest hash), so rows that repeat an id, or an id's many texts, take no place from others.
    """
    named = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    named = named.filter("toxic IN (0, 1)").withColumn("_r", F.xxhash64(F.lit("crf"), "doc_id"))
    picked = [named.filter(F.col("toxic") == t).orderBy("_r", "doc_id").limit(n) for t, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    picked = F.broadcast(picked[0].unionByName(picked[1]))                # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows
    rows = (docs.select("doc_id", "text").join(picked, "doc_id").filter(F.col("text").isNotNull())
            .select("_r", "doc_id", F.struct(F.xxhash64("text").alias("h"), pieces(F.col("text"), F.col("_r"), DOC_CHARS, PIECES).alias("text")).alias("t"), "toxic")
            .groupBy("_r", "doc_id", "toxic").agg(F.min("t").alias("t")).select("_r", "doc_id", "toxic", F.col("t.text").alias("text")).orderBy("_r", "doc_id"))
    out, chars = [], 0
    for r in rows.toLocalIterator():
        if chars + len(r.text) <= SAMPLE_CHARS or not out:
            chars += len(r.text)
            out.append((r.text, int(r.toxic)))
    return out


def prior(labels: DataFrame) -> float:
    """Share of toxic documents among all labelled ones that may be learned from."""
    r = (labels.filter(F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("t")).agg(F.avg("t"))).first()
    return float(r[0] or 0.0)


def tokens(text: str) -> list[str]:
    return folded(TOKEN, text)


def _near_copies(docs: list[np.ndarray]) -> np.ndarray:
    """Weight 1 / n for each of n near copies: documents that share one of three smallest shingle hashes."""
    group = list(range(len(docs)))

    def find(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x
    seen: dict[tuple[int, int], int] = {}
    for d, words in enumerate(docs):
        h = grams(mix(words.astype(np.uint64)), min(4, len(words))) if len(words) else np.zeros(1, np.uint64)
        for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
            key = s, int((h * np.uint64(s)).min())
            group[find(d)] = find(seen.setdefault(key, d))
    roots = [find(d) for d in range(len(docs))]
    n = Counter(roots)
    return np.array([1 / n[r] for r in roots])


def _purity(docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Toxic share of the documents that have a feature, or of its uses (up to USES a document), if larger.

    Three clean ones are added to each, which holds rare features down.
    """
    found = [np.unique(d, return_counts=True) for d in docs]
    ids = np.concatenate([f for f, _ in found])
    n = [len(f) for f, _ in found]
    uses = np.minimum(np.concatenate([c for _, c in found]), USES)
    out = np.zeros(size)
    for each in (np.ones(len(ids)), uses):
        seen = np.bincount(ids, np.repeat(weight, n) * each, size)
        toxic = np.bincount(ids, np.repeat(weight * y, n) * each, size)
        out = np.maximum(out, toxic / (seen + 3.0 * each.mean()))
    return out


def _forward_backward(e: np.ndarray, length: np.ndarray, start: np.ndarray, move: np.ndarray):
    """Marginals of tag 1 and of (tag, next tag), for padded sentences; ``e`` is the score of tag 1 over tag 0."""
    n, width = e.shape
    alpha, beta = np.zeros((n, width, 2)), np.zeros((n, width, 2))
    emit = np.stack([np.zeros_like(e), e], 2)
    alpha[:, 0] = start + emit[:, 0]
    for t in range(1, width):
        a = alpha[:, t - 1, :, None] + move
        alpha[:, t] = np.logaddexp(a[:, 0], a[:, 1]) + emit[:, t]
    for t in range(width - 2, -1, -1):
        b = move + (emit[:, t + 1] + beta[:, t + 1])[:, None, :]
        beta[:, t] = np.where((t + 1 < length)[:, None], np.logaddexp(b[:, :, 0], b[:, :, 1]), 0.0)
    at = np.maximum(length - 1, 0)
    end = alpha[np.arange(n), at]
    z = np.logaddexp(end[:, 0], end[:, 1])
    return np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - z[:, None], 0)), alpha, beta, emit, z


def _padded(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, fill) -> np.ndarray:
    at = starts[:, None] + np.arange(width)[None, :]
    inside = np.arange(width)[None, :] < lengths[:, None]
    return np.where(inside, values[np.minimum(at, len(values) - 1)], fill)


def _neighbours(ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids before and after, with id 1 beyond a sentence."""
    before, after = np.ones_like(ids), np.ones_like(ids)
    before[1:], after[:-1] = ids[:-1], ids[1:]
    before[first], after[last] = 1, 1
    return before, after


def train(rows: list[tuple[str, int]], share: float, steps: int = 240) -> Model:
    """Fit on (text, label) pairs; ``share`` is the toxic share to which the scores are set."""
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in tokens(t)], np.int64) for t, _ in rows]
    y = np.array([t for _, t in rows], np.int64)
    raw_ids: dict[str, int] = {"": 0}
    raw = np.array([[raw_ids.setdefault(f, len(raw_ids)) for f in features(w)] for w in number] or [[0, 0, 0]])
    stop = np.array([w in STOPS for w in number], bool)
    held = [np.unique(raw[u[~stop[u]]]) for u in map(np.unique, docs)]
    often = np.bincount(np.concatenate([*held, np.zeros(0, np.int64)]), minlength=len(raw_ids)) >= MIN_DOCS
    often[0] = False
    place = np.where(often, np.cumsum(often) + 1, 0)            # raw feature to kept one
    known = {f: int(place[i]) for f, i in raw_ids.items() if often[i]}
    size = len(known) + 2
    zero = np.zeros(size)
    nothing = Model(known, zero, zero, zero, np.zeros(2), np.zeros((2, 2)), -9.0, (-12.0, 1.0, 0.0))
    if len(set(y.tolist())) < 2:
        return nothing
    weight = _near_copies(docs)
    odds = _purity([place[raw[d[~stop[d]]]].ravel() for d in docs], y, weight, size)
    odds[:2] = 0
    marks = {f.lstrip("^")[:3] for f, i in known.items() if odds[i] > PURE}
    alike = np.array([w[:3] in marks for w in number], bool)
    rng = np.random.default_rng(11)
    own, tags, length = [], [], []
    for d, label in zip(docs, y):
        words = d[~stop[d]]
        if not len(words):
            continue
        s = np.flatnonzero(np.diff(np.cumsum(stop[d])[~stop[d]], prepend=-1))
        s = np.flatnonzero((np.arange(len(words)) - np.repeat(s, np.diff(np.append(s, len(words))))) % SENTENCE == 0)
        n = np.diff(np.append(s, len(words)))
        f = place[raw[words]]
        t = ((odds[f].max(1) > PURE) & (label == 1)).astype(float)
        # all sentences with a word that looks toxic, and a tenth of the others
        keep = (np.add.reduceat(alike[words].astype(int), s) > 0) | (rng.random(len(s)) < 0.1)
        inside = np.repeat(keep, n)
        own.append(f[inside])
        tags.append(t[inside])
        length.append(n[keep])
    own, tags, length = (np.concatenate(v) if v else np.zeros((0, 3) if v is own else 0, np.int64) for v in (own, tags, length))
    first = np.cumsum(length) - length
    ids = own[:, 0]
    if not tags.any():
        return nothing
    before, after = _neighbours(ids, first, first + length - 1)
    params = [np.zeros(size), np.zeros(size), np.zeros(size), np.zeros(2), np.zeros((2, 2)), np.array([-2.0])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    order = np.argsort(length, kind="stable")
    groups = [order[i: i + 1024] for i in range(0, len(order), 1024)]
    for step in range(1, steps + 1):
        g = groups[rng.integers(len(groups))]
        n, width = length[g], int(length[g].max())
        at = np.minimum(first[g][:, None] + np.arange(width)[None, :], len(ids) - 1)
        inside = np.arange(width)[None, :] < n[:, None]
        w, b, a, t = own[at], before[at], after[at], np.where(inside, tags[at], 0.0)
        e = np.where(inside, params[0][w].sum(2) + params[1][b] + params[2][a] + params[5][0], 0.0)
        p, alpha, beta, emit, z = _forward_backward(e, n, params[3], params[4])
        diff = np.where(inside, p - t, 0.0)
        grads = [np.bincount(w.ravel(), np.repeat(diff.ravel(), w.shape[2]), size), np.bincount(b.ravel(), diff.ravel(), size), np.bincount(a.ravel(), diff.ravel(), size)]
        start = (p[:, 0] - t[:, 0]).sum()
        move = np.zeros((2, 2))
        if width > 1:
            both = inside[:, 1:]
            joint = np.exp(np.minimum(alpha[:, :-1, :, None] + params[4] + (emit + beta)[:, 1:, None, :] - z[:, None, None, None], 0))
            seen = [[(both & (t[:, :-1] == i) & (t[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)]
            move = (joint * both[:, :, None, None]).sum((0, 1)) - np.array(seen)
        grads += [np.array([-start, start]), move, np.array([diff.sum()])]
        for k, (q, d) in enumerate(zip(params, grads)):
            d = d + 0.01 * q * (k < 3)
            m, v = moments[k]
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            q -= 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    params[0][0] = 0.0                   # an unknown word or beginning speaks for nothing by itself
    model = Model(known, *params[:5], float(params[5][0]), (0.0, 1.0, 0.0))
    model.curve = _curve(np.array([(1.0, s, np.log1p(n)) for s, n, _ in _scored(model, [t for t, _ in rows])]), y, weight, share)
    return model


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, share: float) -> tuple[float, float, float]:
    """Logistic curve over (1, evidence, log words), by Newton steps, with the classes weighted to their share in the labels."""
    w = weight * np.where(y == 1, share / max(weight[y == 1].sum(), 1e-9), (1 - share) / max(weight[y == 0].sum(), 1e-9))
    prior, hold = np.array([-4.0, 1.5, 0.0]), np.array([1e-4, 1e-4, 1e-3])
    c = prior.copy()
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -500, 500)))
        g = x.T @ (w * (p - y)) + hold * (c - prior)
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(hold)
        c = c - np.clip(np.linalg.solve(h, g), -1, 1)
    return float(c[0]), float(max(c[1], 0.1)), float(c[2])


def score_texts(model: Model, texts: list[str | None]) -> list[tuple[float, int, list[tuple[int, int, float]]]]:
    """Per text the evidence, the number of words and the toxic spans (first character, past character, peak)."""
    words = [tokens(t or "") for t in texts]
    out: list = [(0.0, 0, [])] * len(texts)
    if not any(words):
        return out
    stop, ids, own = model.look([w for d in words for w in d])
    owner = np.repeat(np.arange(len(texts)), [len(d) for d in words])[~stop]
    number = (np.cumsum(stop) + np.repeat(np.arange(len(texts)), [len(d) for d in words]))[~stop]
    ids, own, base = ids[~stop], own[~stop], int((~stop).sum())
    if not base:
        return out
    owner_first = np.searchsorted(owner, np.arange(len(texts)))
    sizes = np.bincount(owner, minlength=len(texts)).tolist()
    out = [(0.0, n, []) for n in sizes]
    first = np.flatnonzero(np.diff(number, prepend=-1))
    length = np.diff(np.append(first, base))
    before, after = _neighbours(ids, first, first + length - 1)
    e = own + model.before[before] + model.after[after]
    # given its neighbours' tags, a token's odds are at most e + gain: other sentences have no token above the floor
    gain = max(0, model.start[1] - model.start[0], (model.move[:, 1] - model.move[:, 0]).max()) + max(0, (model.move[1] - model.move[0]).max())
    may = np.add.reduceat((e >= np.log(FLOOR / (1 - FLOOR)) - gain).astype(np.int64), first) > 0
    p = np.zeros(base)
    order = np.flatnonzero(may)
    order = order[np.argsort(length[order], kind="stable")]
    i = 0
    while i < len(order):                # sentences of about one length together
        width = int(length[order[i]])
        j = int(np.searchsorted(length[order], max(width * 5 // 4, width + 4), "right"))
        j = min(j, i + max(1, GROUP_TOKENS // max(width, 1)))
        g = order[i:j]
        n, width = length[g], int(length[order[j - 1]])
        inside = np.arange(width)[None, :] < n[:, None]
        padded = np.where(inside, _padded(e, first[g], n, width, 0.0), 0.0)
        marginal = _forward_backward(padded, n, model.start, model.move)[0]
        at = (first[g][:, None] + np.arange(width)[None, :])[inside]
        p[at] = marginal[inside]
        i = j
    sentence = np.zeros(base, bool)
    sentence[first] = True
    hot = np.flatnonzero(p >= FLOOR)
    if not len(hot):
        return out
    new = np.ones(len(hot), bool)
    new[1:] = (np.diff(hot) > 1) | sentence[hot[1:]]
    starts = np.flatnonzero(new)
    spans: dict[int, list[tuple[int, int, float]]] = {}
    for a, b in zip(starts, np.append(starts[1:], len(hot))):
        d = int(owner[hot[a]])
        spans.setdefault(d, []).append((int(hot[a] - owner_first[d]), int(hot[b - 1] - owner_first[d]), float(p[hot[a:b]].max())))
    for d, found in spans.items():
        places = [m.span() for m in TOKEN.finditer(texts[d]) if m.group() not in STOPS]
        evidence = -float(np.log1p(-np.minimum([q for _, _, q in found], 0.98)).sum())
        out[d] = (min(evidence, MOST), sizes[d], [(places[a][0], places[b][1], q) for a, b, q in found])
    return out


def final_score(model: Model, evidence: float, n_words: int) -> float:
    a, b, c = model.curve
    return float(1 / (1 + np.exp(-(a + b * evidence + c * np.log1p(n_words)))))


def _runs(texts: list) -> Iterator[tuple[int, int]]:
    """Rows to score together: about RUN_CHARS characters, or one longer text."""
    i, chars = 0, 0
    for j, t in enumerate(texts):
        chars += len(t) if t is not None else 0
        if chars > RUN_CHARS:
            yield i, j + 1
            i, chars = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def _scored(model: Model, texts: list) -> Iterator[tuple[float, int, list[tuple[int, int, float]]]]:
    for i, j in _runs(texts):
        yield from score_texts(model, texts[i:j])


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` plus tox_score (0 to 1) and tox_spans (start, past, peak; characters)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)       # bounded by the sample's vocabulary

    def make():
        m = shared.value

        def judge(texts: list) -> list[tuple]:
            return [(final_score(m, s, n), [{"start": a, "past": b, "peak": p} for a, b, p in spans]) for s, n, spans in _scored(m, texts)]
        return judge
    return from_texts(docs, docs.columns, make, "tox_score double, tox_spans array<struct<start: long, past: long, peak: double>>")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    return train(sample(docs, labels), prior(labels))
