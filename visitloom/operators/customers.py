"""Customer dimension, order facts, first/second purchase features, churn episodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.functions.columns import cut, days_since_black_friday, slug_state
from visitloom.functions.ordered import lay_track, lift_off, scan
from visitloom.session import store

HOURS_PER_YEAR = 8766


def dim_customer(customers: DataFrame, sales: DataFrame) -> DataFrame:
    """Customer attributes with the region of the latest non-cancelled sale.

    The latest value is a plain aggregate, so a customer with very many sales is combined map-side.
    """
    last = (sales.filter(F.col("is_canceled") == 0).groupBy("fk_customer")
            .agg(F.max_by("region", F.struct("sale_date", "sale_order_store_number", "region")).alias("_region")))
    return (customers.dropDuplicates().join(last, F.col("src_fk_customer") == F.col("fk_customer"), "left")
            .select("src_fk_customer", "id_hash", "gender", "birthday", "cust_created_year",
                    F.coalesce(F.lower("_region"), F.lit("not_set")).alias("country_region")))


def orders_by_customer(sales: DataFrame, customers: DataFrame, as_of: str) -> DataFrame:
    """Paid sale rows per customer and region with age and tenure in whole years."""
    n = (sales.filter(F.col("is_paid") == 1).groupBy("fk_customer", "region")
         .agg(F.count(F.lit(1)).alias("num_orders")))
    years = lambda y: F.floor(F.datediff(F.to_date(F.lit(as_of)), F.make_date(F.col(y), F.lit(1), F.lit(1)))
                              * 24 / HOURS_PER_YEAR)
    return (n.join(customers, F.col("fk_customer") == F.col("src_fk_customer"))
            .filter(F.length("id_hash") > 1)
            .select("id_hash", F.col("region").alias("country_region"), "gender",
                    years("birthday").alias("trunc_age"), years("cust_created_year").alias("cust_created_years"),
                    "num_orders").distinct())


def profile(paths: DataFrame, orders: DataFrame) -> DataFrame:
    """Paths (client_id, part, agg_sessions) with their client's order profile, blanks spelled out."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("not_set"))
    return (paths.join(orders, paths["client_id"] == orders["id_hash"], "full")
            .filter((F.length("agg_sessions") > 1) & (F.length("client_id") > 1))
            .select("client_id", "part", "agg_sessions", text("country_region").alias("country_region"),
                    text("gender").alias("gender"), text("trunc_age").alias("age"),
                    text("cust_created_years").alias("cust_created_years"),
                    F.coalesce("num_orders", F.lit(-1)).alias("num_orders")))


def audience_paths(paths: DataFrame, audience: DataFrame, key: str = "gid") -> DataFrame:
    """Paths of users in a test audience."""
    return paths.join(audience, paths[key] == audience["fk_customer"]).filter(F.col("external_user_id").isNotNull())


def session_rollup(t: DataFrame, key: str, order, lists: dict[str, str], part_rows: int = 100_000) -> DataFrame:
    """Comma-joined ordered lists per client; ``part`` continues a very long client.

    ``sess_len`` is the client's whole number of rows on each part.
    """
    laid, track = lay_track(t, [key], order)
    placed = lift_off(scan(laid, track, _rn=("row_number", None)))
    placed = placed.withColumn("part", F.floor((F.col("_rn") - 1) / part_rows))
    last = placed.filter(F.col("part") > 0).groupBy(F.col(key).alias("_key")).agg(F.max("_rn").alias("_all"))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-1")).alias(c)
    rows = placed.groupBy(key, "part").agg(
        F.array_sort(F.collect_list(F.struct("_rn", *[value(c) for c in lists]))).alias("v"))
    joined = {out: F.array_join(F.col(f"v.{c}"), ",") for c, out in lists.items()}
    # only clients of more than one part have a row in ``last``
    rows = rows.join(last, F.col(key).eqNullSafe(F.col("_key")), "left")
    return rows.select(key, "part", F.coalesce("_all", F.size("v")).alias("sess_len"), *[e.alias(o) for o, e in joined.items()])


def category_tree(products: DataFrame, levels) -> DataFrame:
    return products.groupBy(*levels).agg(F.count(F.lit(1)).alias("num_products"))


# ------------------------------------------------------------------ first / second order
def first_order_features(items: DataFrame, since: str, as_of: str, by_order: bool = False) -> DataFrame:
    """Customer features around the first paid order, and the date of the second one.

    ``by_order=False`` takes the second distinct joined row as the second sale, which can belong to
    the same order; ``by_order=True`` takes the second order.
    """
    attrs = ["channel", "brand_partner", "device", "birth_year", "gender", "state", "expected_delivery_date",
             "delivered_date"]
    paid = F.col("is_paid") == 1
    flags = {"has_marketplace": "is_market_place", "has_crossdocking": "is_crossdocking", "has_private_label": "is_private_label", "has_brands": "is_brand"}
    own = F.when(paid, F.struct(*attrs))
    age = F.year(F.to_date(F.lit(as_of))) - F.col("birth_year")
    kept = {"channel": F.col("channel"), "partner": F.col("brand_partner"), "device": F.col("device"), "age": age, "gender": F.col("gender"),
            "state": F.lower("state"), "expected_delivery_date": F.col("expected_delivery_date"), "delivered_date": F.col("delivered_date")}
    # one row per order, which all below is computed from; the joins behind ``items`` run once
    orders = store(items.groupBy("fk_customer", "sale_date", "sale_order_store_number").agg(
        F.max(paid).alias("_paid"), (~F.min(own).eqNullSafe(F.max(own))).alias("_differ"),
        *[F.min(F.when(paid, v)).alias(n) for n, v in kept.items()],
        *[F.max(F.when(F.col(c) > 0, 1).otherwise(0)).alias(n) for n, c in flags.items()], F.sum("gmv").alias("gmv")))
    place = F.struct("sale_date", "sale_order_store_number", "_differ")
    per = (orders.filter("_paid").groupBy("fk_customer").agg(F.min(place).alias("_f"), *[F.min(n).alias(n) for n in kept])
           .filter((F.col("_f.sale_date") >= F.to_date(F.lit(since))) & F.col("_f.sale_order_store_number").isNotNull()))
    date = lambda c: F.date_format(c, "yyyyMMdd")
    rest = orders.select("fk_customer", "sale_date", "sale_order_store_number", "_paid", *flags, "gmv").join(per.select("fk_customer", "_f"), "fk_customer")
    same = F.col("sale_order_store_number") == F.col("_f.sale_order_store_number")
    later = F.col("_paid") & (F.struct("sale_date", "sale_order_store_number") > F.struct("_f.sale_date", "_f.sale_order_store_number"))
    targets = rest.groupBy("fk_customer").agg(
        F.min(F.when(later, F.col("sale_date"))).alias("_second"), *[F.max(F.when(same, F.col(n))).alias(n) for n in flags],
        F.sum(F.when(same, F.col("gmv"))).cast("double").alias("gmv"))
    second = F.col("_second") if by_order else F.when(F.col("_f._differ"), F.col("_f.sale_date")).otherwise(F.col("_second"))
    return per.join(targets, "fk_customer").select(
        "fk_customer", *[(date(n) if n.endswith("_date") else F.col(n)).alias(n) for n in kept], date(second).alias("second_sale_date"),
        date(F.col("_f.sale_date")).alias("first_sale_date"), F.col("_f.sale_order_store_number").alias("first_sale_number"), *flags, "gmv")


def second_order_labels(features: DataFrame, as_of: str, cutoffs=(15, 30, 90, 180)) -> DataFrame:
    """Waiting time to the second sale and one label per cutoff.

    A missing second sale counts as ``as_of`` + 365 days for the waiting time only;
    ``has_second_purchase`` keeps the truth. Rows with any other missing value are dropped.
    """
    date = lambda c: F.try_to_date(c, "yyyyMMdd")
    need = [c for c in features.columns if c != "second_sale_date"]
    clean = features.na.drop(subset=need)
    first, second = date("first_sale_date"), date("second_sale_date")
    filled = F.coalesce(second, F.date_add(F.to_date(F.lit(as_of)), 365))
    out = clean.withColumns({
        "state": slug_state("state"),
        "days_since_last_bf": days_since_black_friday(first),
        "has_second_purchase": second.isNotNull(),
        "waiting_time": F.datediff(filled, first)})
    return out.withColumns({f"label_{c}": (F.col("waiting_time") < c).cast("int") for c in cutoffs})


def pareto_map(df: DataFrame, c: str, share: float = 0.9, other: str = "OTHER") -> DataFrame:
    """Values by falling frequency; those from the ``share`` point on are renamed ``other``."""
    counts = df.groupBy(c).agg(F.count(F.lit(1)).alias("counts"))
    total = counts.agg(F.sum("counts").alias("t"))
    laid, track = lay_track(counts, [], ["counts", c], descending=["counts"])
    cum = lift_off(scan(laid, track, _upto=("running_sum", "counts")))
    perc = F.col("_upto") * 100 / total.scalar()
    return cum.select(c, "counts", perc.alias("perc"),
                      F.when(perc < share * 100, F.col(c)).otherwise(other).alias(f"{c}_new"))


def pareto_bucket(df: DataFrame, c: str, share: float = 0.9, counted=None) -> DataFrame:
    """Replace ``c`` by its Pareto bucket; values absent from the counted rows drop out."""
    basis = df if counted is None else df.filter(counted)
    return df.join(pareto_map(basis, c, share).select(c, f"{c}_new"), c).drop(c)


def woe_iv(df: DataFrame, bin_col: str, label: str, textbook: bool = False) -> DataFrame:
    """Weight of evidence and information value per bin.

    Default: ``woe = ln(s/n)`` and ``iv = (s/(s+n) - n/(s+n)) woe`` within the bin. ``textbook=True``
    compares the bin's share of all successes with its share of all failures.
    """
    s, n = F.col("success").cast("double"), F.col("nonsuccess").cast("double")
    per = df.groupBy(bin_col).agg(F.sum(F.when(F.col(label) == 1, 1)).alias("success"),
                                  F.sum(F.when(F.col(label) == 0, 1)).alias("nonsuccess"))
    if textbook:
        w = W.partitionBy()
        ds, dn = s / F.sum("success").over(w), n / F.sum("nonsuccess").over(w)
        return per.withColumns({"woe": F.ln(ds / dn), "iv": (ds - dn) * F.ln(ds / dn)})
    return per.withColumns({"woe": F.ln(s / n), "iv": (s / (s + n) - n / (s + n)) * F.ln(s / n)})


# Bin edges of the repurchase study.
GMV_EDGES = [float("-inf"), 75.0, 100.0, 135.0, 155.0, 185.0, 200.0, 245.0, 335.0, float("inf")]
GMV_LABELS = ["0-75", "75-100", "100-135", "135-155", "155-185", "185-200", "200-245", "245-335", "335+"]
AGE_EDGES = [float("-inf"), 22.0, 24.0, 27.0, 32.0, 43.0, 51.0, float("inf")]
AGE_LABELS = ["0-22", "22-24", "24-27", "27-32", "32-43", "43-51", "51+"]
PERIODS = [0, 30, 90, 180, 365]
PERIOD_LABELS = ["first_month", "first_quarter", "first_semester", "this_year"]


def repurchase_bins(df: DataFrame, waiting: str = "waiting_time", status: str = "has_second_purchase") -> DataFrame:
    weeks = F.ceil(F.col(waiting) / 7)
    return df.withColumns({
        "weeks": weeks,
        "repurch_52w": F.col(status) & (weeks < 52),
        "rep_class": F.when(F.col(waiting) <= 365, F.floor(weeks / 8)),
        "period": cut(waiting, PERIODS, PERIOD_LABELS, include_lowest=True)})


# ------------------------------------------------------------------ repeat buyers and churn
def repeat_buyer_fact(items: DataFrame, dims: list[tuple[DataFrame, list[str], str]], since: str) -> DataFrame:
    """Order-item fact of customers who bought on more than one day, joined to ``dims``.

    ``dims`` lists (table, join keys, how). The planner broadcasts a dimension only when its
    measured size allows; the number of purchase days is an aggregate on the customer key.
    """
    live = items.filter((F.col("is_canceled") == 0) & (F.col("sale_date") > F.to_date(F.lit(since))))
    n = (live.groupBy("fk_customer").agg(F.countDistinct("sale_date").alias("n_orders"))
         .filter(F.col("n_orders") > 1))
    return reduce(lambda acc, d: acc.join(d[0], d[1], d[2]), dims, live.join(n, "fk_customer"))


def churn_episodes(orders: DataFrame, as_of: str, gap: int = 365, churn_days: int = 700,
                   key: str = "fk_customer", min_rows=None) -> DataFrame:
    """Last orders before a silence of ``gap`` days and the orders that end one.

    Input: one row per order (customer, order number, date, gmv). Everything is an ordered scan on
    the customer, so one exchange serves all of it.
    """
    order = ("sale_order_store_date", "sale_order_store_number")
    date, today = F.col(order[0]), F.to_date(F.lit(as_of))
    laid, track = lay_track(orders, [key], order, min_rows=min_rows)
    a = scan(laid, track, _next=("lead", order[0]), lifetime_revenue=("running_sum", "gmv"),
             _rn=("row_number", None))
    a = (a.withColumn("next_sale", F.coalesce("_next", today))
         .withColumn("delta", F.datediff("next_sale", date))
         .withColumn("status", (F.col("_next").isNotNull() & (F.col("delta") < churn_days)).cast("int"))
         .withColumn("is_last_order", F.col("delta") >= gap))
    tail = F.col("_next").isNull()
    a = scan(a, track, _before=("lag", "is_last_order"),
             lifetime_orders=("next_known", F.when(tail, F.col("_rn"))),
             churn_sale_date=("next_known", F.when(tail | F.col("is_last_order"), date)))
    a = scan(a, track, episode=("running_sum", F.coalesce(F.col("_before").cast("int"), F.lit(1))))
    kept = a.filter(F.datediff("churn_sale_date", date) <= gap).drop("_rn", "_before")
    k = scan(kept, track, _rn=("row_number", None), _pe=("lag", "episode"), _ne=("lead", "episode"),
             _was_last=("lag", "is_last_order"))
    head = F.col("_pe").isNull() | (F.col("_pe") != F.col("episode"))
    end = F.col("_ne").isNull() | (F.col("_ne") != F.col("episode"))
    k = scan(k, track, _first=("last_known", F.when(head, F.struct(
                 F.col("_rn").alias("rn"), (F.col("lifetime_revenue") - F.col("gmv")).alias("rev")))),
             _last=("next_known", F.when(end, F.col("_rn"))))
    out = k.withColumns({
        "revenue_12m": F.col("lifetime_revenue") - F.col("_first.rev"),
        "orders_12m": F.col("_last") - F.col("_first.rn") + 1,
        "is_reactivation_sale": F.coalesce("_was_last", F.lit(False))})
    out = out.filter(F.col("is_last_order") | F.col("is_reactivation_sale"))
    return lift_off(out).select(
        key, *order, F.col("gmv").alias("last_gmv"), "delta", "status", "is_last_order", "lifetime_revenue",
        "lifetime_orders", "episode", "churn_sale_date", "revenue_12m", "orders_12m", "is_reactivation_sale")
