"""Queries over the catalog: pseudonymisation, splits, text cleaning, profiles, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from visitloom.operators import catalog as C
from visitloom.plans import inputs as N
from visitloom.plans.registry import as_int, query, rounded

CATALOG = f"cat AS ({N.CATALOG})"
SALT, PEPPER = "salt(", ")pepper"
SPECIAL = ["Alpha", "Bravo", "Charlie", "Delta", "Echo"]
cap_sql = lambda w: f"CASE WHEN left({w}, 1) = 'ß' THEN 'Ss' ELSE upper(left({w}, 1)) END || lower(substr({w}, 2))"
title_sql = lambda c: f"array_to_string(list_transform(string_split({c}, ' '), lambda w: {cap_sql('w')}), ' ')"


def branded(t):
    return N.catalog_in(t).withColumns({
        "product_description": F.concat_ws(" ", "brand", "category", "product_description"),
        "box_width": F.col("price") / 7})


@query("d53_pseudonymise", f"""WITH {CATALOG}, b AS (SELECT *, concat_ws(' ', brand, category, product_description) AS txt FROM cat),
n AS (SELECT {cap_sql('brand')} AS bt, count(*) AS c FROM cat GROUP BY 1), r AS (SELECT bt, row_number() OVER (ORDER BY c DESC, bt) AS rn FROM n),
m AS (SELECT bt, CASE rn {' '.join(f"WHEN {i + 1} THEN '{s}'" for i, s in enumerate(SPECIAL))} ELSE '<BRAND_' || lpad(CAST(rn - 6 AS VARCHAR), 6, '0') || '>' END AS nb FROM r),
x AS (SELECT *, replace({title_sql('txt')}, bt, nb) AS t1 FROM b JOIN m ON bt = {cap_sql('brand')})
SELECT upper(md5('{SALT}' || lpad(CAST(product_id AS VARCHAR), 7, '0') || '{PEPPER}')) AS product_id, nb AS brand,
  round(round_even(price / 5, 0) * 5 - 0.01, 2) AS price, round(round_even(price / 7 * 7.43 + 1.2, 1), 1) AS box_width,
  md5(coalesce(replace(t1, {cap_sql('category')}, 'Produto'), t1)) AS text_md5 FROM x""")
def d53(t):
    out = C.pseudonymise(branded(t), SALT, PEPPER, SPECIAL, boxes=["box_width"])
    return out.select("product_id", "brand", F.round("price", 2).alias("price"), F.round("box_width", 1).alias("box_width"),
                      F.md5("product_description").alias("text_md5"))


@query("d53_brand_names", f"""WITH {CATALOG}, n AS (SELECT {cap_sql('brand')} AS bt, count(*) AS c FROM cat GROUP BY 1), r AS (SELECT bt, row_number() OVER (ORDER BY c DESC, bt) AS rn FROM n)
SELECT bt AS brand, CASE rn {' '.join(f"WHEN {i + 1} THEN '{s}'" for i, s in enumerate(SPECIAL))} ELSE '<BRAND_' || lpad(CAST(rn - 6 AS VARCHAR), 6, '0') || '>' END AS new_name FROM r""")
def d53_names(t):
    return C.brand_names(N.catalog_in(t), "brand", SPECIAL).toDF("brand", "new_name")


def _uniform_sql(seed, c: str) -> str:
    return f"(CAST('0x' || left(md5('{seed}|' || CAST({c} AS VARCHAR)), 8) AS BIGINT) / 4294967296.0::DOUBLE)"


@query("d54_perturb", f"""WITH {CATALOG}, j AS (SELECT product_id, price AS raw, round_even(round_even(price * ({_uniform_sql('7/price', 'product_id')} * (1.1::DOUBLE - 0.9::DOUBLE) + 0.9::DOUBLE), 2) / 5, 0) * 5 - 0.01::DOUBLE AS price FROM cat)
SELECT product_id, round(CASE WHEN {_uniform_sql('11/price', 'product_id')} < 0.05 THEN price * 10000 ELSE price END, 2) AS price,
  {', '.join(f"round(CASE WHEN {_uniform_sql('11/' + c, 'product_id')} >= {r} THEN raw / 7 END, 6) AS {c}" for c, r in C.MISSING_RATES.items())},
  CAST(floor({_uniform_sql('11/sector', 'product_id')} * 8) AS BIGINT) AS sector FROM j""")
def d54(t):
    boxes = list(C.MISSING_RATES)
    df = branded(t).withColumns({c: F.col("price") / 7 for c in boxes})
    out = C.perturb(C.jitter_price(df, "price", 0.9, 1.1, 7, "product_id"), 11, "product_id", sectors=8)
    return rounded(out.select("product_id", F.round("price", 2).alias("price"), *boxes, "sector"), *boxes)


@query("d55_stratified_split", f"""WITH {CATALOG}, r AS (SELECT product_id, category, row_number() OVER (PARTITION BY category ORDER BY md5(CAST(product_id AS VARCHAR)), product_id) AS rn,
  count(*) OVER (PARTITION BY category) AS n FROM cat WHERE category IS NOT NULL)
SELECT product_id, category, CASE WHEN rn <= floor(round(n * 0.7, 6)) THEN 'train' WHEN rn <= floor(round(n * 0.8, 6)) THEN 'valid' ELSE 'test' END AS part FROM r""")
def d55(t):
    labelled = N.catalog_in(t).filter(F.col("category").isNotNull()).select("product_id", "category")
    return C.stratified_split(labelled, "category", {"train": 0.7, "valid": 0.1, "test": 0.2}, "product_id")


@query("d56_score_answers", f"""WITH {CATALOG} SELECT product_id, CASE WHEN price % 3 = 0 THEN 'good' ELSE 'bad' END AS predicted, category AS correct_category FROM cat WHERE category IS NOT NULL""")
def d56(t):
    cat = N.catalog_in(t).filter(F.col("category").isNotNull())
    pred = cat.select("product_id", F.when(F.col("price") % 3 == 0, "good").otherwise("bad").alias("category"))
    truth = cat.select("product_id", C.answer_digest("product_id", F.col("category"), SALT, PEPPER).alias("category_hash"))
    return C.score_answers(pred, truth, ["good", "bad"], SALT, PEPPER)


@query("d57_catalog_extract", "SELECT p_partkey, p_name, p_type AS category FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_size % 3 = 1")
def d57(t):
    p = t.part.withColumns({"category": F.col("p_type"), "fk_company": F.col("p_size") % 3})
    return C.catalog_extract(p, ["ECONOMY", "PROMO"], 1).select("p_partkey", "p_name", "category")


_holed = lambda t: t.documents.select("doc_id", F.when(F.col("doc_id") % 10 != 0, F.col("n_chars")).alias("price"),
                                      F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("color"), "n_chars")
HOLED = "h AS (SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN n_chars END AS price, CASE WHEN doc_id % 7 <> 0 THEN lang END AS color, n_chars FROM documents)"


@query("d58_impute_clip", f"""WITH {HOLED}, tr AS (SELECT * FROM h WHERE doc_id % 4 <> 0), q AS (SELECT quantile_cont(price, 0.5) AS med, quantile_cont(n_chars, 0.1) AS lo, quantile_cont(n_chars, 0.9) AS hi FROM tr),
m AS (SELECT color AS mode FROM tr WHERE color IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, color LIMIT 1)
SELECT doc_id, round(coalesce(price, med), 4) AS price, coalesce(color, mode) AS color, round(CASE WHEN n_chars > hi THEN hi WHEN n_chars < lo THEN lo ELSE n_chars END, 4) AS n_chars FROM h, q, m""")
def d58(t):
    h = _holed(t)
    out = C.impute_clip(h.filter(F.col("doc_id") % 4 != 0), h, ["price"], ["color"], ["n_chars"])
    return rounded(out, "price", "n_chars", digits=4)


STOP = ["the", "of", "and", "de", "la", "que"]
CLEAN = """regexp_replace(regexp_replace(coalesce({c}, ' '), '<.*?>', ' ', 'g'), '[!-/:-@\\[-`{{-~]', '', 'g')"""
CLEAN_SQL = ("array_to_string(list_filter(string_split(trim(regexp_replace(lower(" + CLEAN.format(c="{c}") + "), '\\s+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ("
             + ", ".join(f"'{s}'" for s in STOP) + ")), ' ')")


@query("d59_clean_text", "SELECT doc_id, md5(" + CLEAN_SQL.replace("{c}", "text") + ") AS text_md5 FROM documents")
def d59(t):
    return C.clean_text(t.documents, "text", STOP).select("doc_id", F.md5("text").alias("text_md5"))


@query("d59_clean_pages", "SELECT page_id, md5(" + CLEAN_SQL.replace("{c}", "html") + ") AS text_md5 FROM pages")
def d59_pages(t):
    return C.clean_text(t.pages, "html", STOP).select("page_id", F.md5("html").alias("text_md5"))


def _profile_sql(c: str, numeric: bool) -> str:
    v = f"CAST({c} AS VARCHAR)"
    num = (f"round(avg(CAST({c} AS DOUBLE)), 4), round(stddev_samp(CAST({c} AS DOUBLE)), 4), CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE), "
           f"round(quantile_cont({c}, 0.25), 4), round(quantile_cont({c}, 0.5), 4), round(quantile_cont({c}, 0.75), 4)" if numeric else "NULL, NULL, NULL, NULL, NULL, NULL, NULL")
    return f"""SELECT '{c}', count(*), count({c}), count(DISTINCT {c}), {num}, CASE WHEN count(DISTINCT {c}) <= 50 THEN 1 ELSE 0 END,
  (SELECT {v} FROM orders WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {v} LIMIT 1) FROM orders"""


@query("d60_profile_columns", f"""WITH p("column", "rows", non_null, n_distinct, mean, std, "min", "max", q25, q50, q75, few_values, top_value) AS (
  {_profile_sql('o_custkey', True)} UNION ALL {_profile_sql('o_totalprice', True)} UNION ALL {_profile_sql('o_orderstatus', False)} UNION ALL {_profile_sql('o_orderpriority', False)})
SELECT * EXCLUDE (top_value), CASE WHEN "column" <> 'o_totalprice' THEN top_value END AS top_value FROM p""")
def d60(t):
    out = C.profile_columns(t.orders, ["o_custkey", "o_totalprice"], ["o_orderstatus", "o_orderpriority"])
    out = rounded(out, "mean", "std", "q25", "q50", "q75", digits=4)
    # a double prints differently in the two engines, so its top value is left out of the check
    return as_int(out.withColumn("top_value", F.when(F.col("column") != "o_totalprice", F.col("top_value"))), "few_values")


@query("d60_null_counts", f"WITH {HOLED} SELECT CAST(count(*) - count(price) AS BIGINT) AS price, CAST(count(*) - count(color) AS BIGINT) AS color FROM h")
def d60_nulls(t):
    return _holed(t).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("price", "color")])


@query("d61_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def d61(t):
    return C.repeated_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("d61_assert_unique", "SELECT o_orderkey, o_custkey FROM orders")
def d61_assert(t):
    return C.assert_unique(t.orders, ["o_orderkey"]).select("o_orderkey", "o_custkey")
