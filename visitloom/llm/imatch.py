"""I-Match fingerprints with randomised lexicons (DataFrame functions only).

The lexicon is the terms inside a band of inverse document frequency over distinct texts: texts whose SKETCH
smallest hashes of terms agree (copies, and most near copies) count once together, if they are more than a
ten-thousandth of the rows; there are fewer than 10,000 such groups. A document
frequency of at least ``low`` of the texts leaves at most (mean distinct terms) / low terms. Its size is counted: it
is broadcast up to BROADCAST_TERMS terms and joined by a shuffle beyond.

LEXICONS randomised lexicons share out the terms: a hash gives each term one lexicon. They exist in levels: level
1 holds the whole band and a random 1 / 2 ** AHEAD of the other terms, every further level a random
half of the one before, level 0 all terms. A text takes the finest level that is expected to keep TARGET of its
terms, or level 1 from FEWEST terms on, and the level before it. For either, and each lexicon, the text's distinct terms
in that lexicon, sorted, are hashed. Two texts are compared on the finest level both have: their likeness is the share of
equal hashes among the lexicons in which either has a term, so it falls gradually with the terms they do not
share, for short, long and common texts alike. Texts without a common level, whose numbers of terms differ at least
twofold and mostly more, have likeness 0.

Defined cases: a null text counts as empty; two fingerprints of texts without any term are equal. Repeated
ids are ordered by text. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitloom.functions.ordered import lay_track, lift_off, scan
from visitloom.session import store

LEXICONS = 32
TARGET = 24                    # terms a text keeps at its level, expected at least
FEWEST = 8                     # terms expected at level 1 for which that level is taken
BROADCAST_TERMS = 2_000_000
DEEPEST = 63
LOW, HIGH = 0.0005, 0.1        # of the distinct texts
SKETCH = 4
GROUPS = 10_000                # of copies that count once, at most
ONE = 1 << 30                  # weight of a row; whole numbers add up to the same in any order
AHEAD = 5
BAND = 4                       # flag of a term inside the band; 1 and 2: in the first, in the second text
NOTHING = "00000000"
ROWS_PER_BLOCK = 20_000        # of the global order of ids, laid out in blocks
LARGEST = (1 << 63) - 1
LARGEST_TEXT = (1 << 31) - 1
SPLIT = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Distinct lower-case terms, hashed."""
    words = F.array_distinct(F.split(F.lower(text), SPLIT))
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Hashes of the terms with low <= document frequency / documents <= high, each group of copies taken as one document."""
    least = [F.array_min(F.transform("terms", lambda t, i=i: F.xxhash64(F.lit(500 + i), t))) for i in range(SKETCH)]
    rows = docs.select(terms(F.col("text")).alias("terms")).select("terms", F.xxhash64(*least).alias("sketch"))
    groups = store(rows.groupBy("sketch").agg(F.count(F.lit(1)).alias("size")))
    n = groups.agg(F.sum("size")).first()[0] or 0
    heavy = groups.filter(F.col("size") > F.greatest(F.lit(1.0), F.lit(n / GROUPS)))
    weight = F.coalesce(F.greatest(F.lit(1), F.floor(F.lit(ONE) / F.col("size"))), F.lit(ONE)).cast("long")
    copies = heavy.agg(F.sum(F.col("size") - 1)).first()[0] or 0
    n -= copies
    df = (rows.join(F.broadcast(heavy), "sketch", "left").select(F.explode("terms").alias("term"), weight.alias("weight"))
          .groupBy("term").agg((F.sum("weight") / float(ONE)).alias("df")))
    # a group's weights fall short of one by rounding
    return df.filter((F.col("df") >= max(2.0, low * n) - 0.001) & (F.col("df") <= max(2.0, high * n))).select("term")


def _prints(found: DataFrame, names: dict[str, int]) -> DataFrame:
    """Adds fingerprints, as binary, of the texts whose flag is given: the level and both levels' hashes.

    ``_expected1`` and ``_expected2`` are the terms expected at level 1, in units of 1 / 2 ** AHEAD.

    Each step's columns are read more than once in the next, so that Spark keeps the steps apart.
    """
    for w in names.values():
        expected = F.col(f"_expected{w}")
        halvings = F.length(F.bin(F.floor(expected / F.lit(TARGET << AHEAD)).cast("long"))) - 1
        level = F.when(expected < (FEWEST << AHEAD), 0).when(expected < (TARGET << AHEAD), 1).otherwise(F.least(1 + halvings, F.lit(DEEPEST)))
        found = found.withColumn(f"_level{w}", level)
    marks = F.array(*[F.lit(i << 49) for i in range(LEXICONS)]).cast("array<bigint>")

    outlives = lambda e, level: F.shiftright(e, 3).bitwiseAND(DEEPEST) >= level

    def hashes(found: str) -> Column:
        kept = F.transform(found, lambda e: F.shiftright(e, 9))
        # a mark before each lexicon's terms: in sorted order they stand apart
        ordered = F.sort_array(F.concat(kept, marks))
        text = F.array_join(F.transform(ordered, lambda x: F.when(x.bitwiseAND((1 << 49) - 1) == 0, "|").otherwise(x.cast("string"))), "")
        each = F.split(F.substring(text, 2, LARGEST_TEXT), "[|]")
        return F.array_join(F.transform(each, lambda x: F.when(x == "", NOTHING).otherwise(F.lpad(F.hex(F.xxhash64(x).bitwiseAND((1 << 32) - 1)), 8, "0"))), "")

    own = lambda w, level: F.filter("_found", lambda e: (e.bitwiseAND(w) != 0) & outlives(e, level))
    fine = lambda w, level: F.filter(f"_coarse{w}", lambda e: outlives(e, level))
    found = found.withColumns({f"_coarse{w}": own(w, F.col(f"_level{w}") - 1) for w in names.values()})
    for n, w in names.items():
        level = F.col(f"_level{w}")
        found = found.withColumn(f"_fine{w}", fine(w, level))
        found = found.withColumn(n, F.unhex(F.concat(F.lpad(F.hex(level), 2, "0"), hashes(f"_fine{w}"), hashes(f"_coarse{w}"))))
    return found


def fingerprints(texts: DataFrame, lexicon: DataFrame, keys: list[str], first: str, second: str | None = None, carry: dict[str, Column] | None = None) -> DataFrame:
    """``keys`` and the binary fingerprints ``first_print`` and ``second_print`` of one or two text columns.

    ``carry`` adds columns computed from the row, so that the texts are not needed a second time.

    ``texts`` should be partitioned by some of ``keys``, which identify a row: then exploding, the
    broadcast join and the aggregation run in place, without another exchange. ``lexicon`` should be stored.
    """
    carry = carry or {}
    a = terms(F.col(first))
    b = terms(F.col(second)) if second else F.array().cast("array<bigint>")
    mark = lambda found, which: F.transform(found, lambda t: F.struct(t.alias("term"), F.lit(which).cast("long").alias("which")))
    rows = texts.select(*keys, *[v.alias(n) for n, v in carry.items()], a.alias("_a"), b.alias("_b"))
    found = F.concat(mark(F.array_intersect("_a", "_b"), 3), mark(F.array_except("_a", "_b"), 1), mark(F.array_except("_b", "_a"), 2))
    rows = rows.select(*keys, *carry, F.explode_outer(found).alias("_e")).select(*keys, *carry, F.col("_e.term").alias("term"), F.col("_e.which").alias("_which"))
    words = lexicon.select("term", F.lit(True).alias("_known"))
    small = lexicon.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    rows = rows.join(F.broadcast(words) if small else words.hint("merge"), "term", "left")
    # of a term's hash: how many levels it outlives, its lexicon, and its name in sorted order
    drawn = F.xxhash64(F.lit(0), F.col("term"))
    outlives = F.floor(-F.log2((F.call_function("shiftrightunsigned", drawn, F.lit(11)) + 1) / float(1 << 53))).cast("long")
    depth = F.when(F.col("_known"), 1 + outlives).otherwise(F.greatest(1 + outlives - AHEAD, F.lit(0)))
    name = F.call_function("shiftrightunsigned", F.xxhash64(F.lit(1), F.col("term")), F.lit(1))     # lexicon above 49 bits, then flags
    name = F.shiftleft(F.call_function("shiftrightunsigned", name, F.lit(9)), 9)
    packed = name + F.shiftleft(F.least(depth, F.lit(DEEPEST)), 3) + F.when(F.col("_known"), BAND).otherwise(0) + F.col("_which")
    one = rows.select(*keys, *carry, F.when(F.col("term").isNotNull(), packed).alias("_packed"))
    held = lambda w: F.when(F.col("_packed").bitwiseAND(w) != 0, F.when(F.col("_packed").bitwiseAND(BAND) != 0, 1 << AHEAD).otherwise(1)).otherwise(0)
    one = one.groupBy(*keys).agg(*[F.max(n).alias(n) for n in carry], F.collect_list("_packed").alias("_found"),
                                 *[F.coalesce(F.sum(held(w)), F.lit(0)).alias(f"_expected{w}") for w in (1, 2)])
    prints = {f"{first}_print": 1} | ({f"{second}_print": 2} if second else {})
    return _prints(one, prints).select(*keys, *carry, *prints)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes on the finest common level of two binary fingerprints, among the lexicons in which either has a term."""
    level = lambda x: F.conv(F.hex(F.substring(x, 1, 1)), 16, 10).cast("int")
    ahead = level(a) - level(b)
    # the finer half starts at the second byte; of the text with the finer level, the other half is compared
    half = lambda x, later: F.when(later, F.substring(x, 2 + 4 * LEXICONS, 4 * LEXICONS)).otherwise(F.substring(x, 2, 4 * LEXICONS))
    pieces = lambda x: F.regexp_extract_all(F.hex(x), F.lit("[0-9A-F]{8}"), F.lit(0))
    pairs = F.arrays_zip(pieces(half(a, ahead == 1)).alias("a"), pieces(half(b, ahead == -1)).alias("b"))
    held = F.filter(pairs, lambda p: (p["a"] != NOTHING) | (p["b"] != NOTHING))
    share = F.aggregate(held, F.struct(F.lit(0).alias("same"), F.lit(0).alias("held")),
                        lambda t, p: F.struct((t["same"] + (p["a"] == p["b"]).cast("int")).alias("same"), (t["held"] + 1).alias("held")),
                        lambda t: F.coalesce(F.try_divide(t["same"], t["held"]), F.lit(0.0)))
    return F.when(a == b, 1.0).when(F.abs(ahead) > 1, 0.0).otherwise(share)


def edited_likeness(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness.

    The edited text has the last quarter replaced by the start of the next document. Texts are
    shuffled once, by their id; only the starts of texts are sent on to the document before.
    """
    # a row's key has no null, so that joins and aggregations agree on one partitioning: the id, null as the
    # largest, and a hash of the text and of whether there is an id
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LARGEST)).alias("_id"), F.coalesce("text", F.lit("")).alias("text"),
                       F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull()).alias("_h"), F.col("doc_id").isNull().alias("_no_id"))
    words = store(lexicon(base, low, high))
    ids = base.groupBy("_id", "_h", "_no_id").agg(F.count(F.lit(1)).alias("_copies"), F.max(F.length("text")).alias("n_chars"))
    ids = store(ids)
    order = ["_id", "_no_id", "_h"]
    head = ids.orderBy(*order).select("_id", "_h").first()
    laid, track = lay_track(ids, [], order, min_rows=ROWS_PER_BLOCK)
    ordered = lift_off(scan(laid, track, _next=("lead", F.struct("_id", "_h"))))
    if head is not None:                 # the last is followed by the first
        ordered = ordered.withColumn("_next", F.coalesce("_next", F.struct(F.lit(head[0]).cast("long").alias("_id"), F.lit(head[1]).cast("long").alias("_h"))))
    # of rows that repeat an id and a text, all but the last are followed by their twin
    ordered = (ordered.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
               .withColumn("_next", F.when(F.col("_k") < F.col("_copies"), F.struct("_id", "_h")).otherwise(F.col("_next"))))
    keys = ["_id", "_h", "_k", "_no_id", "n_chars", "_nid", "_nh"]
    rows = store(ordered.select("_id", "_h", "_k", "_no_id", F.col("n_chars").cast("long").alias("n_chars"),
                                F.col("_next._id").alias("_nid"), F.col("_next._h").alias("_nh")))

    texts = base.groupBy("_id", "_h").agg(F.first("text").alias("text")) if not rows.filter("_k > 1").isEmpty() else base
    t = texts.select(F.col("_id").alias("_tid"), F.col("_h").alias("_th"), "text")
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    starts = (rows.join(t, (F.col("_nid") == F.col("_tid")) & (F.col("_nh") == F.col("_th")))
              .select(*keys, F.substring(F.col("text"), F.lit(1), quarter).alias("_start")))
    both = starts.join(t, (F.col("_id") == F.col("_tid")) & (F.col("_h") == F.col("_th")))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter), F.col("_start"))
    both = both.select(*keys, "text", edited.alias("edited"))
    digest = F.sha2("edited", 256)
    carry = {n: F.col(n) for n in keys[3:]}
    carry |= {f"_s{i}": F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long") for i in range(4)}
    found = store(fingerprints(both, words, keys[:3], "text", "edited", carry))
    after = found.filter("_k = 1").select(F.col("_id").alias("_aid"), F.col("_h").alias("_ah"), F.col("text_print").alias("_after"))
    sha = F.lower(F.concat(*[F.lpad(F.hex(f"_s{i}"), 16, "0") for i in range(4)]))
    return (found.join(after, (F.col("_nid") == F.col("_aid")) & (F.col("_nh") == F.col("_ah")))
            .select(F.when(~F.col("_no_id"), F.col("_id")).alias("doc_id"), "n_chars", sha.alias("edited_sha256"),
                    F.lower(F.hex("text_print")).alias("fingerprint"), F.lower(F.hex("edited_print")).alias("edited_fingerprint"),
                    likeness(F.col("text_print"), F.col("edited_print")).alias("near_edited"),
                    likeness(F.col("text_print"), F.col("_after")).alias("near_next")))
