"""Product catalog preparation, text cleaning, profiling and data checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.functions.columns import snap_price, title_words, uniform
from visitloom.functions.ordered import lay_track, lift_off, quantiles, scan, split_rank
from visitloom.session import store

# Share of missing values put into each box measure.
MISSING_RATES = {"box_weight": 0.10, "box_length": 0.15, "box_height": 0.08, "box_width": 0.12}
OUTLIER_RATE, OUTLIER_FACTOR = 0.05, 10000


def salted_id(c: str, salt: str, pepper: str, width: int = 7):
    padded = F.format_string(f"%0{width}d", F.col(c).cast("long"))
    return F.upper(F.md5(F.concat(F.lit(salt), padded, F.lit(pepper))))


def brand_names(df: DataFrame, brand: str, special: list[str]) -> DataFrame:
    """New name of each brand: supplied names for the most frequent, numbered ones for the rest."""
    counts = (df.filter(F.col(brand).isNotNull()).groupBy(title_words(brand).alias("_brand"))
              .agg(F.count(F.lit(1)).alias("n")))
    ranked = split_rank(counts, [], ["n", "_brand"], descending=["n"])
    names = F.array(*[F.lit(s) for s in special])
    number = F.col("rn") - len(special) - 1
    return ranked.select("_brand", F.coalesce(
        F.get(names, (F.col("rn") - 1).cast("int")),
        F.format_string("<BRAND_%06d>", number)).alias("_new"))


def pseudonymise(df: DataFrame, salt: str, pepper: str, special: list[str], texts=("product_description",),
                 prices=("price",), boxes=(), mask: str = "Produto") -> DataFrame:
    """Hash ids, snap prices, rescale box sizes, rename brands and mask brand and category in texts.

    Renaming is a join on the brand name, however many brands there are. Each text only has its own
    row's brand and category masked, as title-cased words.
    """
    named = df.withColumn("_brand", title_words("brand"))
    out = named.join(brand_names(df, "brand", special), "_brand", "left")
    cols = {"product_id": salted_id("product_id", salt, pepper)}
    for p in prices:
        cols[p] = snap_price(p)
    for b in boxes:
        cols[b] = F.bround(F.col(b) * 7.43 + 1.2, 1)
    for t in texts:
        titled = title_words(F.coalesce(F.col(t), F.lit("")))
        hidden = F.coalesce(F.replace(titled, F.col("_brand"), F.col("_new")), titled)
        cols[t] = F.coalesce(F.replace(hidden, title_words("category"), F.lit(mask)), hidden)
    return out.withColumns(cols).withColumn("brand", F.col("_new")).drop("_brand", "_new")


def jitter_price(df: DataFrame, price: str, low: float, high: float, seed: int, id_col: str) -> DataFrame:
    """Random factor in [low, high) per row, then the price snap."""
    factor = uniform(f"{seed}/{price}", id_col) * (high - low) + low
    return df.withColumn(price, snap_price(F.bround(F.col(price) * factor, 2)))


def sample_rows(df: DataFrame, fraction: float, seed: int, id_col: str) -> DataFrame:
    """Random share of the rows, the same rows every time for one seed."""
    return df.filter(uniform(seed, id_col) < fraction)


def perturb(df: DataFrame, seed: int, id_col: str, prices=("price",), missing: dict[str, float] | None = None,
            sectors: int = 0) -> DataFrame:
    """Outliers in prices, missing values by column rate and an optional random sector."""
    cols = {}
    draw = lambda what: uniform(f"{seed}/{what}", id_col)
    for p in prices:
        cols[p] = F.when(draw(p) < OUTLIER_RATE, F.col(p) * OUTLIER_FACTOR).otherwise(F.col(p))
    for c, rate in (MISSING_RATES if missing is None else missing).items():
        cols[c] = F.when(draw(c) >= rate, F.col(c))
    if sectors:
        cols["sector"] = F.floor(draw("sector") * sectors)
    return df.withColumns(cols)


def stratified_split(df: DataFrame, label: str, fractions: dict[str, float], id_col: str) -> DataFrame:
    """Exact, repeatable split: within each label, rows in hash order fill the parts in turn."""
    keyed = df.withColumn("_h", F.md5(F.col(id_col).cast("string")))
    ranked = split_rank(keyed, [label], ["_h", id_col], name="_rn")
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_size"))
    placed = ranked.join(sizes, F.col(label).eqNullSafe(F.col("_label")))
    part, upto = None, 0.0
    names = list(fractions)
    for name in names[:-1]:
        upto += fractions[name]
        # round first: 0.7 + 0.1 must not fall short of 0.8 of the rows
        here = F.col("_rn") <= F.floor(F.round(F.col("_size") * upto, 6))
        part = F.when(here, name) if part is None else part.when(here, name)
    part = F.lit(names[-1]) if part is None else part.otherwise(names[-1])
    return placed.withColumn("part", part).drop("_h", "_rn", "_label", "_size")


def answer_digest(id_col: str, label, salt: str, pepper: str):
    return F.upper(F.sha1(F.concat(F.lit(salt), F.col(id_col).cast("string"), label, F.lit(pepper))))


def score_answers(predicted: DataFrame, truth: DataFrame, labels: list[str], salt: str, pepper: str,
                  id_col: str = "product_id") -> DataFrame:
    """Recover each row's true label from its salted digest by trying the labels inside the row."""
    joined = predicted.withColumnRenamed("category", "predicted").join(truth, id_col)
    options = F.array(*[F.lit(x) for x in labels])
    hit = F.filter(options, lambda c: answer_digest(id_col, c, salt, pepper) == F.col("category_hash"))
    return joined.withColumn("correct_category", F.get(hit, F.lit(0))).drop("category_hash")


def catalog_extract(df: DataFrame, categories, company: int | None = None) -> DataFrame:
    out = df.filter(F.col("category").isin(*categories))
    return out if company is None else out.filter(F.col("fk_company") == company)


def mode_of(df: DataFrame, c: str) -> DataFrame:
    """Most frequent value, the smallest among equals."""
    counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.min_by(c, F.struct(-F.col("_n"), F.col(c))).alias(f"_mode_{c}"))


def impute_clip(train: DataFrame, df: DataFrame, medians=(), modes=(), clips=(), low=0.1, high=0.9) -> DataFrame:
    """Fill with training medians and modes, then clip to training quantiles."""
    out = df
    for c in medians:
        m = quantiles(train, c, [0.5]).select("q0")
        out = out.withColumn(c, F.coalesce(F.col(c).cast("double"), m.scalar()))
    for c in modes:
        out = out.withColumn(c, F.coalesce(F.col(c), mode_of(train, c).scalar()))
    for c in clips:
        q = quantiles(train, c, [low, high])
        edge = q.select(F.struct("q0", "q1").alias("e")).scalar()
        lo, hi = edge["q0"], edge["q1"]
        v = F.col(c).cast("double")
        out = out.withColumn(c, F.when(v > hi, hi).when(v < lo, lo).otherwise(v))
    return out


def clean_text(df: DataFrame, c: str, stop: list[str], out: str | None = None) -> DataFrame:
    """Strip tags and punctuation, lower-case, drop stop words."""
    plain = F.regexp_replace(F.coalesce(F.col(c), F.lit(" ")), "<.*?>", " ")
    plain = F.regexp_replace(plain, r"[!-/:-@\[-`{-~]", "")
    words = F.split(F.trim(F.regexp_replace(F.lower(plain), r"\s+", " ")), " ")
    kept = F.filter(words, lambda w: ~w.isin(*stop) & (w != "")) if stop else words
    return df.withColumn(out or c, F.array_join(kept, " "))


def value_shares(df: DataFrame, c: str) -> DataFrame:
    """Counts, shares and cumulative shares by falling frequency."""
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("t")).scalar()
    laid, track = lay_track(counts, [], ["n", c], descending=["n"])
    cum = lift_off(scan(laid, track, _upto=("running_sum", "n")))
    return cum.select(c, "n", (F.col("n") / total).alias("share"), (F.col("_upto") / total).alias("cum_share"))


def profile_columns(df: DataFrame, numeric, text, few: int = 50) -> DataFrame:
    """One row per column: counts, moments, quartiles, distinct values, top value, few-values flag.

    Counts and moments of all columns are one pass of partial aggregation. Distinct and top values and quartiles
    come from each column's own value counts, which keep its type; no row is spread over columns. Of equally
    frequent values the first by its text is the top value.
    """
    cols = [*numeric, *text]
    nothing = F.lit(None).cast("double")
    moments = lambda c: [F.avg(c), F.stddev_samp(c), F.min(c).cast("double"), F.max(c).cast("double")]
    measures = []
    for c in cols:
        four = moments(F.col(f"`{c}`").cast("double")) if c in numeric else [nothing] * 4
        measures.append(F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count(f"`{c}`").alias("non_null"),
                                 *[m.alias(n) for m, n in zip(four, ("mean", "std", "min", "max"))]))
    flat = df.agg(F.array(*measures).alias("_m")).select(F.inline("_m"))
    counts = {c: df.select(F.col(f"`{c}`").alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n")) for c in cols}
    counts |= {c: store(counts[c]) for c in numeric}          # read twice
    name = lambda c: F.lit(c).alias("column")
    tops = reduce(DataFrame.unionByName, [
        counts[c].agg(F.count(F.lit(1)).alias("n_distinct"), F.min(F.struct(-F.col("n"), F.col("value").cast("string").alias("v")))["v"].alias("top_value"))
        .select(name(c), "n_distinct", "top_value") for c in cols])
    out = flat.join(tops, "column", "left")
    if numeric:
        values = reduce(DataFrame.unionByName, [counts[c].select(name(c), F.col("value").cast("double").alias("value"), "n") for c in numeric])
        q = quantiles(values, "value", [0.25, 0.5, 0.75], ["column"], n="n").toDF("column", "q25", "q50", "q75")
        out = out.join(q, "column", "left")
    else:
        out = out.withColumns({q: nothing for q in ("q25", "q50", "q75")})
    return out.withColumn("few_values", F.col("n_distinct") <= few)


def repeated_keys(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def assert_unique(df: DataFrame, keys) -> DataFrame:
    """Return ``df`` unchanged, or raise when a key repeats."""
    if not repeated_keys(df, keys).isEmpty():
        raise ValueError(f"repeated key in {list(keys)}")
    return df
