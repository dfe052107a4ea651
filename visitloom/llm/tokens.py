"""Count tokens with a tokenizer compiled to a deterministic transducer.

The vocabulary merges pairs: of all neighbours whose concatenation is a piece, the best-scored merges
first; characters left over that are no piece become their UTF-8 bytes. A sequence of pieces is an
encoding exactly if every two neighbours are the encoding of their concatenation. So the encoding of a
prefix plus one character ends with the one piece that fits the last piece before it. A state holds, for
each earlier position from which the text since then is the start of some piece, the last piece up to
there and its token count relative to now: finitely many, since pieces are short. States are compiled when
first met, and each transition (state, character) carries the change of the token count.

Where the vocabulary has no piece across two neighbouring characters, the transducer is back in its
start state. Such cuts give chunk maps (open head, tokens of what is between, open tail), or one open
text where a chunk has no cut. They compose associatively: a tail and the next head are walked once
both are known. Chunks of one long text are mapped in different tasks; their maps compose pairwise
in a balanced tree, as in a parallel prefix scan.

Defined cases: null counts as empty and has no tokens. Repeated ids are counted row by row. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.llm.common import from_texts

CHUNK = 1 << 18                # characters of a long text that one task maps at a time
KEPT = 800_000                 # unit counts, and compiled transitions, that a worker keeps before it drops them
SPACE = "▁"
START, INNER = "^", "-"       # in front of a chunk: whether its text starts there

_compiled: dict[str, Transducer] = {}


class Map(NamedTuple):
    """What a chunk does: it ends the unit that ``head`` is the end of, counts, and leaves ``tail`` open."""

    closed: bool
    head: str
    count: int
    tail: str


class Transducer:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size())
               if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in ids}
        self.begins = {p[:n] for p in self.score for n in range(1, len(p))}
        inside = {p[i: i + 2] for p in self.score for i in range(len(p) - 1)}
        if any(a != SPACE and b == SPACE for a, b in inside) or any("\n" in x for x in inside):
            raise ValueError("this vocabulary has pieces across words")
        self.unit = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.fits: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.kept = 0
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.start = self._state(("", ((0, "", 0),)))
        self.units: dict[str, int] = {}

    def _state(self, key: tuple) -> int:
        at = self.ids.get(key)
        if at is None:
            at = self.ids[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return at

    def _neighbours(self, a: str, b: str) -> bool:
        """Whether merging a + b from its characters ends in a, b: the definition, on two pieces."""
        ok = self.fits.get((a, b))
        if ok is None:
            parts = list(a + b)
            while True:
                scores = [self.score.get(x + y) for x, y in zip(parts, parts[1:])]
                best = max((s for s in scores if s is not None), default=None)
                if best is None:
                    break
                i = scores.index(best)
                parts[i: i + 2] = [parts[i] + parts[i + 1]]
            ok = self.fits[a, b] = parts == [a, b]
        return ok

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        recent, starts = self.states[state]
        for back, last, tokens in starts:
            piece = recent[len(recent) - back:] + c
            if (back == 0 or piece in self.score) and (last == "" or self._neighbours(last, piece)):
                break
        else:
            raise AssertionError("every text has an encoding")
        change = tokens + (1 if piece in self.score else len(piece.encode()))
        kept = [(n + 1, p, t - change) for n, p, t in starts if recent[len(recent) - n:] + c in self.begins]
        longest = max((n for n, _, _ in kept), default=0)
        text = (recent + c)[len(recent) + 1 - longest:]
        self.kept += 1
        return self._state((text, (*kept, (0, piece, 0)))), change

    def walk(self, unit: str) -> int:
        """Tokens of one unit, from the start state."""
        if self.kept > KEPT:
            self.reset()
        if len(self.units) > KEPT:       # counts are quick to find again; compiled transitions stay
            self.units.clear()
        if len(self.fits) > KEPT:
            self.fits.clear()
        state, total, steps = self.start, 0, self.steps
        for c in unit:
            step = steps[state].get(c)
            if step is None:
                step = steps[state][c] = self._compile(state, c)
            state, change = step
            total += change
        if len(unit) <= 64:
            self.units[unit] = total
        return total

    def count(self, text: str) -> int:
        """Tokens of a text that starts and ends at a cut."""
        total, known = 0, self.units.get
        for unit in self.unit.findall(text):
            n = known(unit)
            total += self.walk(unit) if n is None else n
        return total

    def map(self, chunk: str) -> Map:
        cuts = self.unit.findall(chunk)
        if len(cuts) < 2:
            return Map(False, chunk, 0, "")
        return Map(True, cuts[0], self.count(chunk[len(cuts[0]): len(chunk) - len(cuts[-1])]), cuts[-1])

    def compose(self, a: Map, b: Map) -> Map:
        if not a.closed:
            joined = self.map(a.head + b.head)
            if not b.closed:
                return joined
            if not joined.closed:
                return Map(True, joined.head, b.count, b.tail)
            return Map(True, joined.head, joined.count + self.count(joined.tail) + b.count, b.tail)
        if b.closed:
            return Map(True, a.head, a.count + self.count(a.tail + b.head) + b.count, b.tail)
        joined = self.map(a.tail + b.head)
        if not joined.closed:
            return Map(True, a.head, a.count, joined.head)
        return Map(True, a.head, a.count + self.count(joined.head) + joined.count, joined.tail)

    def total(self, maps: list[Map]) -> int:
        while len(maps) > 1:
            maps = [self.compose(*maps[i: i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        m = maps[0]
        return self.count(m.head) + m.count + self.count(m.tail)


def escaped(text: str) -> str:
    """Blanks become the visible mark; a text that is not empty gets one in front."""
    return SPACE + text.replace(" ", SPACE) if text else text


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def count_tokens(docs: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row per row of ``docs``."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long").alias("n_bytes")

    def whole():
        t = transducer(model)
        return lambda texts: [(t.count(escaped(x)),) for x in texts]

    def mapped():
        t = transducer(model)
        return lambda texts: [t.map(SPACE + x[1:] if x[0] == START else x[1:]) for x in texts]

    def composed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")       # the maps of one text; tails and heads are single units
        maps = [Map(*x) for x in group[list(Map._fields)].itertuples(index=False)]
        return pd.DataFrame({"doc_id": group.doc_id.iloc[:1], "n_bytes": group.n_bytes.iloc[:1], "n_tokens": [transducer(model).total(maps)]})

    short = from_texts(base.filter(F.length("text") <= chunk).select("doc_id", size, "text"), ["doc_id", "n_bytes"], whole, "n_tokens long")
    long = base.filter(F.length("text") > chunk).select("doc_id", F.monotonically_increasing_id().alias("row"), size, "text")
    pieces = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int"))
    long = (long.select("doc_id", "row", "n_bytes", "text", F.explode(pieces).alias("chunk"))
            .withColumn("text", F.concat(F.when(F.col("chunk") == 0, START).otherwise(INNER),
                                         F.translate(F.substring(F.col("text"), F.col("chunk") * chunk + 1, F.lit(chunk)), " ", SPACE)))
            .repartition("row", "chunk"))
    maps = from_texts(long, ["doc_id", "row", "n_bytes", "chunk"], mapped, "closed boolean, head string, count long, tail string")
    return short.unionByName(maps.groupBy("row").applyInPandas(composed, "doc_id long, n_bytes long, n_tokens long"))
