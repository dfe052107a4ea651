"""Marketing cost allocation and incremental lift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitloom.functions.columns import digest, recode
from visitloom.session import store

# Source-system ids and the warehouse ids they map to (all others map to 0, companies to 1).
STORE_IDS = {1: 352, 3: 219, 5: 21, 7: 50, 11: 66, 13: 158, 14: 4, 15: 67, 16: 30, 17: 18, 19: 37,
             20: 70, 21: 24, 23: 47, 24: 888, 25: 6, 26: 92, 29: 55}
DEVICE_IDS = {3: 146, 4: 330, 5: 606, 6: 514, 7: 422, 8: 698, 9: 790, 10: 1250, 11: 1342, 13: 238}
CURRENCY_IDS = {1: 173, 2: 265, 3: 357, 4: 449, 5: 817, 6: 633, 7: 541, 8: 725}
COMPANY_IDS = {1: 1, 3: 2, 5: 3, 7: 4}


HIDDEN_COUNTRY, TOOL_ACCOUNT = 9, 6


def recode_costs(costs: DataFrame) -> DataFrame:
    """Warehouse ids of a ledger row; the company follows from the store."""
    return costs.withColumns({
        "id_company": recode("store_id", COMPANY_IDS, 1),
        "id_country": F.when(F.col("country_id") == HIDDEN_COUNTRY, 0).otherwise(F.coalesce("country_id", F.lit(0))),
        "category_name": category_group(),
        "is_tool": F.coalesce((F.col("gl_account_id") == TOOL_ACCOUNT).cast("int"), F.lit(0)),
        "id_store": recode("store_id", STORE_IDS, 0),
        "id_device_platform": recode("device_id", DEVICE_IDS, 0),
        "id_currency": recode("currency_id", CURRENCY_IDS, 0)})


def category_group(c: str = "category_name"):
    """Category families by name prefix."""
    v = F.col(c)
    return (F.when(v.startswith("Canais"), "PERFORMANCE")
            .when(v.startswith("Strategic Marketing"), "STRATEGIC MARKETING")
            .when(v.startswith("Creative Marketing"), "CREATIVE MARKETING")
            .when(v.startswith("Trade Marketing"), "TRADE MARKETING")
            .when(v == "B2B Services", "B2B").otherwise(v))


MAX_REPEATS = 1_000_000     # repeated keys that are broadcast


def drop_repeats(df: DataFrame, key: str) -> DataFrame:
    """One row per value of ``key``, like ``dropDuplicates``, for keys that seldom repeat.

    Only hashes of the key are shuffled. Rows whose hash occurs once stay where they are, the others
    (repeats, and the rare equal hashes of different keys) are deduplicated by the key itself.
    """
    hashed = df.withColumn("_hash", F.xxhash64(key))
    repeats = store(hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_hash"))
    n = repeats.count()
    if n == 0:
        return df
    if n > MAX_REPEATS:
        return df.dropDuplicates([key])
    repeats = F.broadcast(repeats)
    once = hashed.join(repeats, "_hash", "left_anti")
    again = hashed.join(repeats, "_hash", "left_semi").dropDuplicates([key])
    return once.unionByName(again).drop("_hash")


def allocate_costs(costs: DataFrame, fx: DataFrame) -> DataFrame:
    """Daily costs stay on their day; all others are spread evenly over the days of their month.

    ``fx``: ``id_currency, fx_date, id_company, rate``; a missing rate counts as 1. Rows are
    deduplicated on the ledger key before the spread. The rate is the one of the cost's own date.
    ``costs`` is read twice and should be a stored table. Rows per day are many times the ledger: sum them up
    where they arise rather than store them.
    """
    daily = F.col("cost_allocation") == 1
    base = recode_costs(drop_repeats(costs, "id_cost"))
    rated = base.join(
        fx, (base["id_currency"] == fx["fx_currency"]) & (base["cost_date"] == fx["fx_date"])
        & (base["id_company"] == fx["fx_company"]), "left")
    month_start = F.trunc("cost_date", "month")
    days = F.when(daily, F.array("cost_date")).otherwise(F.sequence(month_start, F.last_day("cost_date")))
    value = F.when(daily, F.col("value").cast("double")).otherwise(
        F.col("value").cast("double") / F.dayofmonth(F.last_day("cost_date")))
    # everything is computed on the ledger row; the explode only copies it to its days
    priced = rated.select(
        "id_cost", days.alias("_days"), "id_country", "id_company", "id_store", "id_currency",
        digest("supplier_name", "account_name", "short_description", "channel_name",
               "id_device_platform").alias("utm_hash"),
        "legal_entity_name", "category_name", "supplier_name", "account_name", "short_description", "channel_name",
        "id_device_platform", "is_tool",
        F.when(daily, "DAILY").otherwise("MONTHLY").alias("cost_allocation"),
        (value * F.coalesce("rate", F.lit(1.0))).alias("exchanged_value"),
        value.alias("original_value"))
    return priced.withColumn("id_date", F.explode("_days")).drop("_days")


def cost_by_utm(allocated: DataFrame, utms: DataFrame) -> DataFrame:
    """Average cost per utm, with the utm's descriptive columns."""
    per = allocated.groupBy("utm_hash").agg(
        F.count(F.lit(1)).alias("cnt"), F.avg("exchanged_value").alias("avg_cost"),
        F.avg("original_value").alias("avg_original_cost"))
    return per.join(utms, "utm_hash")


def match_on_value(a: DataFrame, b: DataFrame, value_a: str, value_b: str, key: str = "utm_hash") -> DataFrame:
    """Equality on key and amount, amounts compared at two decimals."""
    cents = lambda c: F.col(c).cast("decimal(18,2)")
    return (a.withColumn("_cents", cents(value_a))
            .join(b.withColumn("_cents", cents(value_b)), [key, "_cents"]).drop("_cents"))


def top_costs(costs: DataFrame, partners: DataFrame, key: str, cost: str, k: int = 10) -> DataFrame:
    return costs.join(partners, key).orderBy(F.col(cost).desc(), F.col("id_cost")).limit(k)


def eligible(audience: DataFrame, start: str, end: str) -> DataFrame:
    """First interaction inside (start, end] and not uninstalled before ``end``."""
    d = F.col("first_interaction")
    gone = F.col("first_uninstall")
    return audience.filter((d > F.to_date(F.lit(start))) & (d <= F.to_date(F.lit(end)))
                           & (gone.isNull() | (gone >= F.to_date(F.lit(end)))))


def lift(audience: DataFrame, measures, arm: str = "is_control", by=()) -> DataFrame:
    """(a - b f)/(a + b f) per measure, a = treated (arm 0), b = control (arm 1), f = n_a/n_b."""
    treated, control = F.col(arm) == 0, F.col(arm) == 1
    aggs = [F.count_if(treated).alias("n_treated"), F.count_if(control).alias("n_control")]
    for m in measures:
        aggs += [F.sum(F.when(treated, F.col(m))).cast("double").alias(f"_a_{m}"),
                 F.sum(F.when(control, F.col(m))).cast("double").alias(f"_b_{m}")]
    f = F.try_divide(F.col("n_treated"), F.col("n_control"))
    out = []
    for m in measures:
        a, b = F.col(f"_a_{m}"), F.col(f"_b_{m}") * f
        out.append(F.try_divide(a - b, a + b).alias(f"dif_{m}"))
    return audience.groupBy(*by).agg(*aggs).select(*by, "n_treated", "n_control", *out)


def in_both_arms(audience: DataFrame, user: str = "external_user_id", arm: str = "is_control") -> DataFrame:
    return (audience.groupBy(user).agg(F.countDistinct(arm).alias("arms")).filter(F.col("arms") > 1))


def split_user_key(audience: DataFrame, user: str = "external_user_id") -> DataFrame:
    """``id-country`` into its two parts."""
    return audience.withColumns({
        "fk_customer": F.regexp_extract(user, "^(.*?)-(.*)$", 1),
        "country": F.regexp_extract(user, "^(.*?)-(.*)$", 2)})


def study_lift(rows: DataFrame, measures, keys=("study_id", "cell_id")) -> DataFrame:
    """Study totals of text measures, ``#NULL!`` as 0, in long form without all-zero measures."""
    num = lambda m: F.replace(F.col(m), F.lit("#NULL!"), F.lit("0")).cast("double")
    totals = rows.groupBy(*keys).agg(*[F.sum(num(m)).alias(m) for m in measures])
    pairs = ", ".join(f"'{m}', `{m}`" for m in measures)
    long = totals.select(*keys, F.expr(f"stack({len(measures)}, {pairs}) as (measure, total)"))
    live = long.groupBy("measure").agg(F.sum(F.abs("total")).alias("_t")).filter(F.col("_t") != 0)
    return long.join(F.broadcast(live.select("measure")), "measure", "left_semi")
