"""One registered query per operator, over whole tables, and the oracle SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.llm import audit, decontaminate, imatch, jaccard, language, licenses, lines, mixing, pigeonhole, repeats, tokens, toxicity, urls
from visitloom.llm.common import held_out, table

MODEL = "piece_bpe_32k.model"
MIN_SITES = 10


def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def op3_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link_documents(table(spark, folder, "documents"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.tag(docs, model).select(
        "doc_id", held_out().alias("held_out"), F.col("tox_score").alias("score"),
        (F.col("tox_score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.col("tox_spans").alias("spans"))


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    out = lines.strip_lines(docs, MIN_SITES)
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A page is labelled by the document of the same id; low quality is bad."""
    marks = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return urls.judge(table(spark, folder, "pages").select("page_id", "url"), marks)


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return language.predict(docs, language.fit(docs))


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_token_count(spark: SparkSession, folder: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(MODEL)
    out = tokens.count_tokens(table(spark, folder, "documents"), os.fspath(model))
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)


def op10_imatch(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.edited_likeness(table(spark, folder, "documents"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit_texts(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_run_detection(spark: SparkSession, folder: str) -> DataFrame:
    docs = repeats.repeat_tails(table(spark, folder, "documents").select("doc_id", "text"))
    out = repeats.find_runs(docs)
    # the longest run; of those the first, then the shorter period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines_ = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["s"]).alias("start"), best["length"].alias("length"), (-best["q"]).alias("period"),
        F.floor(1000 * best["length"] / -best["q"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines_, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


def op13_vector_links(spark: SparkSession, folder: str) -> DataFrame:
    return pigeonhole.link_vectors(table(spark, folder, "embeddings"))


RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mix_sources, op2_license_scan, op3_ngram_jaccard, op4_toxicity, op5_line_dedup, op6_url_filter,
                            op7_language, op8_decontaminate, op9_token_count, op10_imatch, op11_filter_audit, op12_run_detection,
                            op13_vector_links)}

_OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
base AS (
  SELECT *, CAST(greatest(round(ln(size + 2.718281828459045) * 100), 1) AS BIGINT) AS v,
         (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM sized),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn FROM src),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(rn - 1) % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM ranked),
filled AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap0,
            coalesce(sum(w) OVER (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w0,
            sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(w) OVER () AS all_w FROM weighed),
marked AS (SELECT *, cap * (all_w - w0) <= w * (total - cap0) AS capped FROM filled),
level AS (
  SELECT (max(total) - coalesce(sum(cap) FILTER (capped), 0)) / nullif(max(all_w) - coalesce(sum(w) FILTER (capped), 0), 0) AS level FROM marked),
targets AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE w * level END AS target FROM marked CROSS JOIN level),
classes AS (
  SELECT b.source, v, CAST(sum(size) AS BIGINT) AS s, any_value(target) AS target
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source GROUP BY b.source, v),
ahead AS (
  SELECT *, coalesce(sum(s) OVER p, 0) AS s0, coalesce(sum(v * s) OVER p, 0) AS vs0, sum(v * s) OVER (PARTITION BY source) AS vs_all
  FROM classes WINDOW p AS (PARTITION BY source ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
full_classes AS (SELECT *, v * (target - 2.0::DOUBLE * s0) >= 2.0::DOUBLE * (vs_all - vs0) AS capped FROM ahead),
lambdas AS (
  SELECT source, (any_value(target) - 2.0::DOUBLE * coalesce(sum(s) FILTER (capped), 0)) / nullif(sum(v * s) FILTER (NOT capped), 0) AS lam
  FROM full_classes GROUP BY source),
expected AS (
  SELECT b.*, t.source_size, t.target, coalesce(least(2.0::DOUBLE, lam * v), 2.0::DOUBLE) AS e
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source JOIN lambdas l ON b.source IS NOT DISTINCT FROM l.source),
split AS (SELECT *, CAST(floor(e + 1e-9) AS BIGINT) AS sure, greatest(e - floor(e + 1e-9), 0) AS p FROM expected),
odds AS (SELECT *, CASE WHEN p > 1e-9 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM split),
ordered AS (
  SELECT *, sum(sure * size) OVER (PARTITION BY source) AS certain,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY q ASC NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM odds),
taken AS (SELECT *, sure + CASE WHEN q IS NOT NULL AND before + size / 2.0::DOUBLE <= target - certain THEN 1 ELSE 0 END AS copies FROM ordered)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies AS BIGINT) AS copies, CAST(copies * size AS BIGINT) AS taken FROM taken"""

_OP5 = f"""
WITH split AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, source, i - 1 AS pos, ls[i] AS raw, trim(ls[i]) AS line
  FROM (SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS i FROM split)),
spread AS (
  SELECT line, min({{'d': doc_id, 'p': pos}}) AS first FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (
  SELECT l.*, s.line IS NOT NULL AND (s.first.d <> l.doc_id OR s.first.p <> l.pos) AS gone FROM lines l LEFT JOIN spread s ON l.line = s.line),
kept AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS rest FROM marked GROUP BY doc_id)
SELECT s.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
       CASE WHEN s.text IS NOT NULL THEN CAST(length(rest) AS BIGINT) END AS kept_chars,
       CASE WHEN s.text IS NOT NULL THEN sha256(rest) END AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP8 = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
runs AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, r.n, i, item_id FROM runs r JOIN windows b ON r.n = b.n AND r.words = b.words),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN places p ON d.doc_id = p.doc_id LEFT JOIN named m ON d.doc_id = m.doc_id"""

_OP11 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM texts GROUP BY t),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
fails AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END AS a, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 1 ELSE 0 END AS b,
         CASE WHEN 100 * length(regexp_replace(texts.t, '[^A-Z]', '', 'g')) > 3 * length(texts.t) THEN 1 ELSE 0 END AS c,
         CASE WHEN regexp_matches(texts.t, '[#$%&*|]') THEN 1 ELSE 0 END AS d, CASE WHEN texts.doc_id > first THEN 1 ELSE 0 END AS e
  FROM texts LEFT JOIN marks ON texts.doc_id = marks.doc_id JOIN firsts ON texts.t = firsts.t),
cells AS (
  SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY 1, 2),
letters AS (SELECT i, substr('ABCDE', i, 1) AS f, 1 << (i - 1) AS bit FROM range(1, 6) r(i)),
orders AS (
  SELECT l1.f || l2.f || l3.f || l4.f || l5.f AS filter_order, [l1.bit, l2.bit, l3.bit, l4.bit, l5.bit] AS bits
  FROM letters l1, letters l2, letters l3, letters l4, letters l5
  WHERE l1.bit + l2.bit + l3.bit + l4.bit + l5.bit = 31 AND l1.bit <> l2.bit AND (l1.bit | l2.bit | l3.bit | l4.bit | l5.bit) = 31),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS BIGINT) AS before
  FROM (SELECT filter_order, bits, unnest(range(1, 6)) AS step FROM orders)),
parts AS (SELECT DISTINCT part FROM cells),
counted AS (
  SELECT p.part, filter_order, step, s.bit,
         coalesce(sum(n) FILTER ((mask & (s.before | s.bit)) = 0), 0) AS kept,
         coalesce(sum(n) FILTER ((mask & s.before) = 0 AND (mask & s.bit) <> 0), 0) AS removed,
         coalesce(sum(n) FILTER ((mask & s.before) <> 0 AND (mask & s.bit) <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = s.bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER ((mask & s.before) = 0 AND (mask & s.bit) <> 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER ((mask & s.before) = 0 AND (mask & s.bit) <> 0), 0) AS toxic_lost
  FROM parts p JOIN cells c ON p.part = c.part CROSS JOIN steps s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted"""

_OP13 = """
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT u AS vec_id, (SELECT count(*) FROM links l WHERE l.u = reach.u) AS n_links, min(v) AS component_id, min(v) = u AS kept
FROM reach GROUP BY u"""

SQL: dict[str, str] = {"op1_mix_sources": _OP1, "op5_line_dedup": _OP5, "op8_decontaminate": _OP8, "op11_filter_audit": _OP11, "op13_vector_links": _OP13}
