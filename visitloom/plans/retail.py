"""Queries over orders and customers: dimensions, purchase features, churn, sales profiles."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.functions.columns import cut
from visitloom.operators import customers as C
from visitloom.operators import timeseries as S
from visitloom.plans import inputs as N
from visitloom.plans.journeys import LONG, _groups_sql, path_rows
from visitloom.operators import paths as P
from visitloom.plans.registry import as_int, as_text, query, rounded
from visitloom.session import store

AS_OF = "2002-01-01"
ITEMS = f"items AS ({N.ITEMS})"
DIM = f"dim AS ({N.CUSTOMERS})"


def sales(t):
    return N.items_in(t).withColumnRenamed("state", "region")


@query("d39_dim_customer", f"""WITH {ITEMS}, {DIM}, r AS (SELECT fk_customer, state, row_number() OVER (PARTITION BY fk_customer ORDER BY sale_date DESC, sale_order_store_number DESC, state DESC) AS rn FROM items WHERE is_canceled = 0)
SELECT src_fk_customer, id_hash, gender, birthday, cust_created_year, coalesce(lower(state), 'not_set') AS country_region
FROM dim LEFT JOIN r ON fk_customer = src_fk_customer AND rn = 1""")
def d39(t):
    return C.dim_customer(N.customers_in(t).drop("country_region"), sales(t))


ORDERS_BY = f"""obc AS (SELECT DISTINCT id_hash, n.state AS country_region, gender,
  CAST(floor(date_diff('day', make_date(birthday, 1, 1), DATE '{AS_OF}') * 24 / 8766) AS BIGINT) AS trunc_age,
  CAST(floor(date_diff('day', make_date(cust_created_year, 1, 1), DATE '{AS_OF}') * 24 / 8766) AS BIGINT) AS cust_created_years, num_orders
  FROM (SELECT fk_customer, state, count(*) AS num_orders FROM items WHERE is_paid = 1 GROUP BY 1, 2) n JOIN dim ON fk_customer = src_fk_customer)"""


@query("d40_orders_by_customer", f"WITH {ITEMS}, {DIM}, {ORDERS_BY} SELECT * FROM obc")
def d40(t):
    return C.orders_by_customer(sales(t), N.customers_in(t).drop("country_region"), AS_OF)


_D41_PATHS = f"""{LONG}, ser AS ({_groups_sql('conv_group', ['utm_hash', 'sess', 'trin'], 'max(cv_marker)', ';')})"""


@query("d41_profile", f"""WITH {_D41_PATHS}, {ITEMS}, cust AS ({N.CUSTOMERS}), {ORDERS_BY.replace('JOIN dim', 'JOIN cust')}
SELECT md5(gid) AS client_id, part, agg_sessions, coalesce(country_region, 'not_set') AS country_region, coalesce(gender, 'not_set') AS gender,
  coalesce(CAST(trunc_age AS VARCHAR), 'not_set') AS age, coalesce(CAST(cust_created_years AS VARCHAR), 'not_set') AS cust_created_years, coalesce(num_orders, -1) AS num_orders
FROM ser LEFT JOIN obc ON md5(gid) = id_hash""")
def d41(t):
    lines = P.serialise_paths(path_rows(t), "gid", "d").select(F.md5("gid").alias("client_id"), "part", "agg_sessions")
    return C.profile(lines, C.orders_by_customer(sales(t), N.customers_in(t).drop("country_region"), AS_OF))


@query("d41_audience_paths", f"""WITH {_D41_PATHS}, aud AS ({N.AUDIENCE}), sp AS (SELECT external_user_id, os, regexp_extract(external_user_id, '^(.*?)-(.*)$', 1) AS fk_customer FROM aud)
SELECT gid, part, agg_sessions, external_user_id, os FROM ser JOIN sp ON gid = fk_customer""")
def d41_audience(t):
    from visitloom.operators.costs import split_user_key
    lines = P.serialise_paths(path_rows(t), "gid", "d")
    return C.audience_paths(lines, split_user_key(N.audience_in(t))).select("gid", "part", "agg_sessions", "external_user_id", "os")


@query("d42_session_rollup", f"""WITH tt AS ({N.TOUCHES}) SELECT fvid, 0 AS part, count(*) AS sess_len, string_agg(CAST(sess AS VARCHAR), ',' ORDER BY sess, event_id) AS times,
  string_agg(coalesce(CAST(value AS VARCHAR), '-1'), ',' ORDER BY sess, event_id) AS "values" FROM tt GROUP BY fvid""")
def d42(t):
    return C.session_rollup(N.touches_in(t), "fvid", ["sess", "event_id"], {"sess": "times", "value": "values"})


@query("d42_events_by_user", "SELECT user_id, count(*) AS cnt FROM events GROUP BY 1 ORDER BY cnt DESC, user_id")
def d42_users(t):
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.col("cnt").desc(), "user_id")


@query("d42_session_peek", """SELECT event_id AS visit_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_bounce,
  '0:1,' || CASE event_type WHEN 'purchase' THEN '6' WHEN 'view' THEN '2' WHEN 'click' THEN '1' WHEN 'signup' THEN '3' ELSE '4' END || ':1' AS actions,
  'unknown,' || CASE event_type WHEN 'purchase' THEN 'refund_purchase,refund_purchase' WHEN 'view' THEN 'add_to_cart,add_to_cart' WHEN 'click' THEN 'prod_detail_views,prod_detail_views'
    WHEN 'signup' THEN 'remove_from_cart,remove_from_cart' ELSE 'check_out,check_out' END AS impressions FROM events""")
def d42_peek(t):
    from visitloom.functions.columns import recode
    # Action codes of product hits.
    names = {"0": "unknown", "1": "prod_detail_views", "2": "add_to_cart", "3": "remove_from_cart", "4": "check_out",
             "5": "complete_purchase", "6": "refund_purchase", "7": "refund_purchase", "8": "check_out_options"}
    acts = F.transform("hits", lambda h: h["eCommerceAction"]["action_type"])
    counts = F.transform(F.array_distinct(acts), lambda a: F.concat_ws(
        ":", a, F.size(F.filter(acts, lambda b: b == a)).cast("string")))
    shown = F.flatten(F.transform("hits", lambda h: F.transform(
        h["product"], lambda p: recode(h["eCommerceAction"]["action_type"], names))))
    return N.sessions_in(t).select("visit_id", F.coalesce("totals.bounces", F.lit(0)).alias("is_bounce"),
                                   F.array_join(F.array_sort(counts), ",").alias("actions"),
                                   F.array_join(shown, ",").alias("impressions"))


@query("d43_category_tree", "SELECT p_type, p_brand, count(*) AS num_products FROM part WHERE p_size > 5 GROUP BY 1, 2")
def d43(t):
    return C.category_tree(t.part.filter(F.col("p_size") > 5), ["p_type", "p_brand"])


# ------------------------------------------------------------------ D44-D48
SINCE = "1996-01-01"


def first_order_items(t):
    c = F.col("fk_customer")
    return N.items_in(t).withColumns({
        "brand_partner": F.concat(F.lit("partner"), (F.col("sale_order_store_number") % 12).cast("string")),
        "birth_year": (1950 + c % 50).cast("int"),
        "gender": F.when(c % 3 == 0, "female").when(c % 3 == 1, "male").otherwise("other"),
        "expected_delivery_date": F.date_add("sale_date", 7),
        "is_crossdocking": (F.col("product_id") % 5 == 0).cast("int"),
        "is_private_label": (F.col("product_id") % 7 == 0).cast("int"),
        "is_brand": F.col("brand").isin("Brand#1", "Brand#2", "Brand#3").cast("int")})


FO_ITEMS = f"""{ITEMS}, fi AS (SELECT *, 'partner' || CAST(sale_order_store_number % 12 AS VARCHAR) AS brand_partner, 1950 + fk_customer % 50 AS birth_year,
  CASE fk_customer % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' ELSE 'other' END AS gender, sale_date + 7 AS expected_delivery_date,
  CASE WHEN product_id % 5 = 0 THEN 1 ELSE 0 END AS is_crossdocking, CASE WHEN product_id % 7 = 0 THEN 1 ELSE 0 END AS is_private_label,
  CASE WHEN brand IN ('Brand#1','Brand#2','Brand#3') THEN 1 ELSE 0 END AS is_brand FROM items)"""


def _first_order_sql(by_order: bool) -> str:
    attrs = "channel, brand_partner, device, birth_year, gender, state, expected_delivery_date, delivered_date"
    rows = (f"SELECT DISTINCT fk_customer, sale_date, sale_order_store_number, {attrs} FROM fi WHERE is_paid = 1" if not by_order else
            "SELECT fk_customer, sale_date, sale_order_store_number, " + ", ".join(f"min({a}) AS {a}" for a in attrs.split(", "))
            + " FROM fi WHERE is_paid = 1 GROUP BY 1, 2, 3")
    return f"""{FO_ITEMS}, o1 AS (SELECT fk_customer, sale_date, sale_order_store_number, row_number() OVER (PARTITION BY fk_customer ORDER BY sale_date, sale_order_store_number) AS rn
  FROM (SELECT DISTINCT fk_customer, sale_date, sale_order_store_number FROM fi WHERE is_paid = 1)),
f1 AS (SELECT fk_customer, sale_date AS fd, sale_order_store_number AS fn FROM o1 WHERE rn = 1 AND sale_date >= DATE '{SINCE}'),
jr AS ({rows}), rk AS (SELECT *, row_number() OVER (PARTITION BY fk_customer ORDER BY sale_date) AS rn FROM jr),
ft AS (SELECT rk.fk_customer, min(channel) AS channel, min(brand_partner) AS partner, min(device) AS device, {AS_OF[:4]} - max(birth_year) AS age, min(gender) AS gender,
  min(lower(state)) AS state, strftime(min(expected_delivery_date), '%Y%m%d') AS expected_delivery_date, strftime(min(delivered_date), '%Y%m%d') AS delivered_date,
  strftime(min(CASE WHEN rn = 2 THEN sale_date END), '%Y%m%d') AS second_sale_date FROM rk WHERE fk_customer IN (SELECT fk_customer FROM f1) GROUP BY 1),
tg AS (SELECT fi.fk_customer, fn AS first_sale_number, max(is_market_place) AS has_marketplace, max(is_crossdocking) AS has_crossdocking, max(is_private_label) AS has_private_label,
  max(is_brand) AS has_brands, round(CAST(sum(gmv) AS DOUBLE), 4) AS gmv FROM fi JOIN f1 ON f1.fk_customer = fi.fk_customer AND fn = sale_order_store_number GROUP BY 1, 2),
fo AS (SELECT ft.*, first_sale_number, strftime(fd, '%Y%m%d') AS first_sale_date, has_marketplace, has_crossdocking, has_private_label, has_brands, gmv
  FROM ft JOIN f1 USING (fk_customer) JOIN tg ON tg.fk_customer = ft.fk_customer AND first_sale_number = fn)"""


def first_orders(t, by_order=False):
    return rounded(C.first_order_features(first_order_items(t), SINCE, AS_OF, by_order), "gmv", digits=4)


@query("d44_first_order_features", f"WITH {_first_order_sql(False)} SELECT * FROM fo")
def d44(t):
    return first_orders(t)


@query("d44_first_order_by_order", f"WITH {_first_order_sql(True)} SELECT * FROM fo")
def d44_by_order(t):
    return first_orders(t, True)


def bf_sql(year: str) -> str:
    """Day after the fourth Thursday of November (isodow: Thursday = 4)."""
    nov = f"make_date(CAST({year} AS BIGINT), 11, 1)"
    return f"({nov} + CAST((11 - isodow({nov})) % 7 + 22 AS INTEGER))"


def since_bf_sql(d: str) -> str:
    y = f"year({d})"
    return f"date_diff('day', CASE WHEN {d} <= {bf_sql(y)} THEN {bf_sql(y + ' - 1')} ELSE {bf_sql(y)} END, {d})"


CUTOFFS = (15, 30, 90, 180)
LABELS = f"""{_first_order_sql(True)}, lb AS (SELECT * REPLACE (replace(state, ' ', '_') AS state), CAST(strptime(first_sale_date, '%Y%m%d') AS DATE) AS f,
  CAST(strptime(second_sale_date, '%Y%m%d') AS DATE) AS s FROM fo),
lw AS (SELECT *, {since_bf_sql('f')} AS days_since_last_bf, CASE WHEN s IS NULL THEN 0 ELSE 1 END AS has_second_purchase,
  date_diff('day', f, coalesce(s, DATE '{AS_OF}' + 365)) AS waiting_time FROM lb)"""


def labelled(t):
    return C.second_order_labels(first_orders(t, True), AS_OF, CUTOFFS)


@query("d45_second_order_labels", f"""WITH {LABELS} SELECT fk_customer, state, days_since_last_bf, has_second_purchase, waiting_time,
  {', '.join(f'CASE WHEN waiting_time < {c} THEN 1 ELSE 0 END AS label_{c}' for c in CUTOFFS)} FROM lw""")
def d45(t):
    return as_int(labelled(t).select("fk_customer", "state", "days_since_last_bf", "has_second_purchase", "waiting_time",
                                     *[f"label_{c}" for c in CUTOFFS]), "has_second_purchase")


MONTHLY = [30, 61, 91, 122, 152, 183, 213, 244, 274, 305, 335, 366]


@query("d45_monthly_cutoffs", f"WITH {LABELS} SELECT " + ", ".join(
    f"CAST(sum(CASE WHEN waiting_time < {c} THEN 1 ELSE 0 END) AS BIGINT) AS label_{c}" for c in MONTHLY) + " FROM lw")
def d45_monthly(t):
    out = C.second_order_labels(first_orders(t, True), AS_OF, MONTHLY)
    return out.agg(*[F.sum(f"label_{c}").alias(f"label_{c}") for c in MONTHLY])


@query("d46_pareto_bucket", f"""WITH {_first_order_sql(True)}, c AS (SELECT partner, count(*) AS counts FROM fo WHERE second_sale_date IS NOT NULL GROUP BY 1),
m AS (SELECT partner, CASE WHEN sum(counts) OVER (ORDER BY counts DESC, partner) * 100.0 / sum(counts) OVER () < 90 THEN partner ELSE 'OTHER' END AS partner_new FROM c)
SELECT fk_customer, partner_new FROM fo JOIN m USING (partner)""")
def d46(t):
    fo = store(first_orders(t, True))
    return C.pareto_bucket(fo, "partner", counted=F.col("second_sale_date").isNotNull()).select("fk_customer", "partner_new")


def _cut_sql(c: str, edges, labels) -> str:
    arms = " ".join(f"WHEN {c} <= {e} THEN '{l}'" for e, l in zip(edges[1:-1], labels))
    return f"CASE {arms} ELSE '{labels[-1]}' END"


def _woe_sql(bin_expr: str, textbook: bool = False) -> str:
    base = f"""WITH {LABELS}, b AS (SELECT {bin_expr} AS bin, sum(CASE WHEN waiting_time < 180 THEN 1 END) AS success, sum(CASE WHEN waiting_time >= 180 THEN 1 END) AS nonsuccess FROM lw GROUP BY 1)"""
    if textbook:
        return base + """, d AS (SELECT *, success / sum(success) OVER () AS ds, nonsuccess / sum(nonsuccess) OVER () AS dn FROM b)
SELECT bin, CAST(success AS BIGINT) AS success, CAST(nonsuccess AS BIGINT) AS nonsuccess, round(ln(ds / dn), 6) AS woe, round((ds - dn) * ln(ds / dn), 6) AS iv FROM d"""
    return base + """ SELECT bin, CAST(success AS BIGINT) AS success, CAST(nonsuccess AS BIGINT) AS nonsuccess, round(ln(success / nonsuccess), 6) AS woe,
  round((success / (success + nonsuccess) - nonsuccess / (success + nonsuccess)) * ln(success / nonsuccess), 6) AS iv FROM b"""


def _binned(t, expr):
    return labelled(t).select(expr.alias("bin"), F.col("label_180").alias("label"))


@query("d47_woe_gmv", _woe_sql(_cut_sql("gmv", C.GMV_EDGES, C.GMV_LABELS)))
def d47_gmv(t):
    return rounded(C.woe_iv(_binned(t, cut("gmv", C.GMV_EDGES, C.GMV_LABELS)), "bin", "label"), "woe", "iv")


@query("d47_woe_age", _woe_sql(_cut_sql("age", C.AGE_EDGES, C.AGE_LABELS)))
def d47_age(t):
    return rounded(C.woe_iv(_binned(t, cut("age", C.AGE_EDGES, C.AGE_LABELS)), "bin", "label"), "woe", "iv")


@query("d47_woe_state_textbook", _woe_sql("state", True))
def d47_state(t):
    return rounded(C.woe_iv(_binned(t, F.col("state")), "bin", "label", textbook=True), "woe", "iv")


@query("d48_repurchase_bins", f"""WITH {LABELS} SELECT fk_customer, CAST(ceil(waiting_time / 7) AS BIGINT) AS weeks,
  CASE WHEN has_second_purchase = 1 AND ceil(waiting_time / 7) < 52 THEN 1 ELSE 0 END AS repurch_52w,
  CASE WHEN waiting_time <= 365 THEN CAST(floor(ceil(waiting_time / 7) / 8) AS BIGINT) END AS rep_class,
  CASE WHEN waiting_time < 0 THEN NULL WHEN waiting_time <= 30 THEN 'first_month' WHEN waiting_time <= 90 THEN 'first_quarter' WHEN waiting_time <= 180 THEN 'first_semester'
    WHEN waiting_time <= 365 THEN 'this_year' END AS period FROM lw""")
def d48(t):
    out = C.repurchase_bins(labelled(t)).select("fk_customer", "weeks", "repurch_52w", "rep_class", "period")
    return as_int(out, "repurch_52w")


# ------------------------------------------------------------------ D49-D52
def planning(t):
    return t.part.groupBy(F.col("p_type").alias("category"), F.col("p_brand").alias("brand")).agg(
        F.max(F.when(F.col("p_size") > 25, " ").otherwise("core")).alias("cluster"),
        F.max(F.when(F.col("p_retailprice") < 950, " ").otherwise(F.col("p_size").cast("string"))).alias("age"))


def repeat_fact(t):
    """Sold items of repeat buyers with nine dimensions and two planning tables, 37 columns.

    The tables have no ids of campaigns, coupons, payments or deliveries; these stem from tax, discount, priority and line status.
    """
    c = F.col
    word = lambda i: F.element_at(F.split("p_name", " "), i)
    items = N.items_in(
        t, c("l_suppkey").alias("fk_channel_partner"), c("c_nationkey").alias("fk_address"), F.concat(F.lit("sku"), c("p_partkey").cast("string")).alias("sku_config"),
        (c("l_tax") > 0.04).cast("int").alias("is_campaign"), (c("l_discount") > 0.05).cast("int").alias("is_coupon"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("fk_payment"), c("l_linestatus").alias("fk_delivery"),
        (c("l_extendedprice").cast("decimal(18,2)") * c("l_discount").cast("decimal(4,2)")).cast("decimal(18,4)").alias("product_discount"),
        (c("l_extendedprice").cast("decimal(18,2)") * c("l_tax").cast("decimal(4,2)")).cast("decimal(18,4)").alias("shipping_discount")).drop("state", "category", "brand", "is_market_place")
    dim = N.customers_in(t).select(c("src_fk_customer").alias("fk_customer"), "gender", "birthday", "cust_created_year")
    paid = N.items_in(t).filter("is_paid = 1").groupBy("fk_customer").agg(F.min("sale_date").alias("first_order_paid"))
    partner = t.supplier.select(c("s_suppkey").alias("fk_channel_partner"), c("s_name").alias("channel_partner_name"))
    product = t.part.select(
        c("p_partkey").alias("product_id"), c("p_name").alias("product_name"), c("p_brand").alias("brand"), c("p_type").alias("category"),
        word(-1).alias("division"), (c("p_size") % 3).cast("int").alias("business_unit"), word(1).alias("product_color"),
        F.when(c("p_size") % 2 == 0, "unisex").otherwise("adult").alias("product_gender"),
        F.concat(F.lit("img/"), c("p_partkey").cast("string"), F.lit("/1-z.jpg")).alias("product_image_url"),
        c("p_retailprice").alias("product_original_price"), (c("p_size") % 2 == 0).cast("int").alias("is_market_place"))
    payment = t.orders.select("o_orderpriority").distinct().select(
        F.substring("o_orderpriority", 1, 1).cast("int").alias("fk_payment"), F.lower(F.substring_index("o_orderpriority", "-", -1)).alias("payment_method_name"))
    delivery = t.lineitem.select(c("l_linestatus").alias("fk_delivery")).distinct().withColumn(
        "shipping_condition", F.when(c("fk_delivery") == "O", "express").otherwise("regular"))
    address = t.nation.join(t.region, c("n_regionkey") == c("r_regionkey")).select(
        c("n_nationkey").alias("fk_address"), c("n_name").alias("delivery_city"), F.upper(F.right("n_name", F.lit(2))).alias("delivery_state_code"),
        c("r_name").alias("delivery_country_region"))
    feed = t.part.filter(c("p_partkey") % 4 != 0).select(
        F.concat(F.lit("sku"), c("p_partkey").cast("string")).alias("sku_config"), F.concat(F.lit("g/"), c("p_name")).alias("google_product_category"))
    ext = t.part.groupBy(c("p_type").alias("category"), c("p_brand").alias("brand"), (c("p_size") % 2 == 0).cast("int").alias("is_market_place")).agg(
        F.max(F.floor(c("p_retailprice") / 100)).alias("ticketrange"), F.max(F.floor(c("p_retailprice") / 500)).alias("originalpricerange"))
    fact = C.repeat_buyer_fact(items, [
        (dim, ["fk_customer"], "inner"), (paid, ["fk_customer"], "left"), (partner, ["fk_channel_partner"], "inner"), (product, ["product_id"], "inner"),
        (payment, ["fk_payment"], "inner"), (delivery, ["fk_delivery"], "inner"), (address, ["fk_address"], "inner"),
        (planning(t), ["category", "brand"], "inner"), (ext, ["category", "brand", "is_market_place"], "inner"), (feed, ["sku_config"], "left")], "1995-06-01")
    known = lambda n: F.when(c(n) == " ", "Unknown").otherwise(c(n))
    return fact.withColumns({
        "customer_age": F.year("sale_date") - c("birthday"),
        "google_product_category": F.coalesce("google_product_category", F.lit("Unknown")),
        "platform_name": F.when(c("fk_payment") <= 2, "mobile").otherwise("desktop"),
        "planning_cluster": known("cluster"), "planning_age": known("age")})


_FACT_COLS = ("fk_customer, sale_order_store_number, line_no, n_orders, gender, customer_age, cust_created_year, channel, channel_partner_name, sku_config, is_campaign, "
              "product_name, product_gender, product_color, brand, product_image_url, category, division, business_unit, google_product_category, payment_method_name, "
              "shipping_condition, is_coupon, device, platform_name, delivery_city, delivery_state_code, delivery_country_region, planning_cluster, planning_age, "
              "ticketrange, originalpricerange")
_FACT_MORE = f""", l.l_suppkey AS fk_channel_partner, c.c_nationkey AS fk_address, 'sku' || CAST(p.p_partkey AS VARCHAR) AS sku_config, CASE WHEN l.l_tax > 0.04 THEN 1 ELSE 0 END AS is_campaign,
  CASE WHEN l.l_discount > 0.05 THEN 1 ELSE 0 END AS is_coupon, CAST(substr(o.o_orderpriority, 1, 1) AS INT) AS fk_payment, l.l_linestatus AS fk_delivery,
  CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS product_discount,
  CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS shipping_discount"""


@query("d49_repeat_buyer_fact", f"""WITH items AS ({N.items_sql(_FACT_MORE)}), {DIM}, lv AS (SELECT * EXCLUDE (state, category, brand, is_market_place) FROM items WHERE is_canceled = 0 AND sale_date > DATE '1995-06-01'),
no AS (SELECT fk_customer, count(DISTINCT sale_date) AS n_orders FROM lv GROUP BY 1 HAVING count(DISTINCT sale_date) > 1),
pd AS (SELECT fk_customer, min(sale_date) AS first_order_paid FROM items WHERE is_paid = 1 GROUP BY 1),
pr AS (SELECT p_partkey AS product_id, p_name AS product_name, p_brand AS brand, p_type AS category, string_split(p_name, ' ')[-1] AS division, p_size % 3 AS business_unit,
  string_split(p_name, ' ')[1] AS product_color, CASE WHEN p_size % 2 = 0 THEN 'unisex' ELSE 'adult' END AS product_gender, 'img/' || CAST(p_partkey AS VARCHAR) || '/1-z.jpg' AS product_image_url,
  p_retailprice AS product_original_price, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS is_market_place FROM part),
pay AS (SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INT) AS fk_payment, lower(split_part(o_orderpriority, '-', -1)) AS payment_method_name FROM orders),
ad AS (SELECT n_nationkey AS fk_address, n_name AS delivery_city, upper(right(n_name, 2)) AS delivery_state_code, r_name AS delivery_country_region FROM nation JOIN region ON r_regionkey = n_regionkey),
pl AS (SELECT p_type AS category, p_brand AS brand, max(CASE WHEN p_size > 25 THEN ' ' ELSE 'core' END) AS cluster,
  max(CASE WHEN p_retailprice < 950 THEN ' ' ELSE CAST(p_size AS VARCHAR) END) AS age FROM part GROUP BY 1, 2),
ex AS (SELECT p_type AS category, p_brand AS brand, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS is_market_place, CAST(max(floor(p_retailprice / 100)) AS BIGINT) AS ticketrange,
  CAST(max(floor(p_retailprice / 500)) AS BIGINT) AS originalpricerange FROM part GROUP BY 1, 2, 3),
fd AS (SELECT 'sku' || CAST(p_partkey AS VARCHAR) AS sku_config, 'g/' || p_name AS gpc FROM part WHERE p_partkey % 4 <> 0),
fact AS (SELECT lv.*, n_orders, gender, year(sale_date) - birthday AS customer_age, cust_created_year, first_order_paid, s_name AS channel_partner_name, pr.* EXCLUDE (product_id),
  coalesce(gpc, 'Unknown') AS google_product_category, payment_method_name, CASE WHEN fk_delivery = 'O' THEN 'express' ELSE 'regular' END AS shipping_condition,
  CASE WHEN fk_payment <= 2 THEN 'mobile' ELSE 'desktop' END AS platform_name, delivery_city, delivery_state_code, delivery_country_region,
  CASE WHEN cluster = ' ' THEN 'Unknown' ELSE cluster END AS planning_cluster, CASE WHEN age = ' ' THEN 'Unknown' ELSE age END AS planning_age, ticketrange, originalpricerange
  FROM lv JOIN no USING (fk_customer) JOIN dim ON src_fk_customer = lv.fk_customer LEFT JOIN pd ON pd.fk_customer = lv.fk_customer JOIN supplier ON s_suppkey = fk_channel_partner
  JOIN pr USING (product_id) JOIN pay USING (fk_payment) JOIN ad USING (fk_address) JOIN pl USING (category, brand) JOIN ex USING (category, brand, is_market_place) LEFT JOIN fd USING (sku_config))
SELECT {_FACT_COLS}, CAST(sale_date AS VARCHAR) AS sale_date, CAST(first_order_paid AS VARCHAR) AS first_order_paid, count(*) AS n, round(CAST(sum(gmv) AS DOUBLE), 4) AS sale_value,
  round(CAST(sum(product_discount) AS DOUBLE), 4) AS product_discount, round(CAST(sum(shipping_discount) AS DOUBLE), 4) AS shipping_discount, round(max(product_original_price), 4) AS product_original_price
FROM fact GROUP BY ALL""")
def d49(t):
    out = repeat_fact(t).groupBy(*_FACT_COLS.split(", "), F.col("sale_date").cast("string").alias("sale_date"), F.col("first_order_paid").cast("string").alias("first_order_paid")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("gmv").alias("sale_value"), F.sum("product_discount").alias("product_discount"),
        F.sum("shipping_discount").alias("shipping_discount"), F.max("product_original_price").alias("product_original_price"))
    return rounded(out, "sale_value", "product_discount", "shipping_discount", "product_original_price", digits=4)


@query("d49_sku_urls", "SELECT DISTINCT 'sku' || CAST(l_partkey AS VARCHAR) AS sku_config, 'http://img/' || CAST(l_partkey % 97 AS VARCHAR) || '/1-x.jpg' AS url FROM lineitem")
def d49_urls(t):
    k = F.col("l_partkey").cast("string")
    return t.lineitem.select(F.concat(F.lit("sku"), k).alias("sku_config"),
                             F.concat(F.lit("http://img/"), (F.col("l_partkey") % 97).cast("string"), F.lit("/1-x.jpg")).alias("url")).distinct()


CHURN_IN = """co AS (SELECT o_custkey AS fk_customer, o_orderkey AS num, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(18,2)) AS gmv FROM orders)"""
_w = "PARTITION BY fk_customer ORDER BY d, num"
CHURN = f"""{CHURN_IN}, a AS (SELECT *, coalesce(lead(d) OVER ({_w}), DATE '{AS_OF}') AS nx, lead(d) OVER ({_w}) IS NOT NULL AS has_next,
  sum(gmv) OVER ({_w} ROWS UNBOUNDED PRECEDING) AS lifetime_revenue, count(*) OVER (PARTITION BY fk_customer) AS lifetime_orders FROM co),
b AS (SELECT *, date_diff('day', d, nx) AS delta, date_diff('day', d, nx) >= 365 AS is_last FROM a),
b2 AS (SELECT *, lag(is_last) OVER ({_w}) AS pl FROM b),
e AS (SELECT *, CAST(sum(CASE WHEN pl IS NULL OR pl THEN 1 ELSE 0 END) OVER ({_w} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM b2),
f AS (SELECT *, max(d) OVER (PARTITION BY fk_customer, episode) AS churn FROM e),
g AS (SELECT * FROM f WHERE date_diff('day', d, churn) <= 365),
h AS (SELECT *, sum(gmv) OVER (PARTITION BY fk_customer, episode ORDER BY d, num ROWS UNBOUNDED PRECEDING) AS r12, count(*) OVER (PARTITION BY fk_customer, episode) AS o12,
  coalesce(lag(is_last) OVER ({_w}), FALSE) AS react FROM g)"""


def churn_orders(t):
    return t.orders.select(F.col("o_custkey").alias("fk_customer"), F.col("o_orderkey").alias("sale_order_store_number"),
                           F.to_date("o_orderdate").alias("sale_order_store_date"),
                           F.col("o_totalprice").cast("decimal(18,2)").alias("gmv"))


@query("d50_churn_episodes", f"""WITH {CHURN} SELECT fk_customer, num AS sale_order_store_number, CAST(d AS VARCHAR) AS sale_order_store_date, CAST(gmv AS DOUBLE) AS last_gmv, delta,
  CASE WHEN has_next AND delta < 700 THEN 1 ELSE 0 END AS status, CASE WHEN is_last THEN 1 ELSE 0 END AS is_last_order, CAST(lifetime_revenue AS DOUBLE) AS lifetime_revenue, lifetime_orders, episode,
  CAST(churn AS VARCHAR) AS churn_sale_date, CAST(r12 AS DOUBLE) AS revenue_12m, o12 AS orders_12m, CASE WHEN react THEN 1 ELSE 0 END AS is_reactivation_sale FROM h WHERE is_last OR react""")
def d50(t):
    out = C.churn_episodes(churn_orders(t), AS_OF)
    out = as_int(as_text(out, "sale_order_store_date", "churn_sale_date"), "is_last_order", "is_reactivation_sale", "episode")
    return out.withColumns({c: F.col(c).cast("double") for c in ("last_gmv", "lifetime_revenue", "revenue_12m")})


def hourly_sales(t):
    total = F.col("o_totalprice").cast("decimal(18,2)")
    return t.orders.select(F.to_date("o_orderdate").alias("sale_date"), (F.col("o_orderkey") % 24).cast("int").alias("sale_hour"),
                           F.when(F.col("o_orderstatus") != "P", total).otherwise(F.lit(0).cast("decimal(18,2)")).alias("gtv_after"),
                           total.alias("gtv_before"))


HOURLY = f"""hs AS (SELECT CAST(o_orderdate AS DATE) AS sd, CAST(o_orderkey % 24 AS INT) AS h, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS ga,
  CAST(o_totalprice AS DECIMAL(18,2)) AS gb FROM orders), hd AS (SELECT *, year(sd) AS y, date_diff('day', {bf_sql('year(sd)')}, sd) AS d FROM hs)"""


@query("d51_hourly_event_share", f"""WITH {HOURLY}, gd AS (SELECT y, d, h, CAST(sum(ga) AS DOUBLE) AS ga, CAST(sum(gb) AS DOUBLE) AS gb, sum(CASE WHEN gb <> 0 THEN 1 ELSE 0 END) AS p
  FROM hd WHERE d BETWEEN -1 AND 5 AND y BETWEEN 1997 AND 2000 GROUP BY 1, 2, 3),
nq AS (SELECT d, h, ga / nullif(sum(ga) OVER (PARTITION BY y), 0) AS a, gb / nullif(sum(gb) OVER (PARTITION BY y), 0) AS b, p / nullif(sum(p) OVER (PARTITION BY y), 0) AS p FROM gd),
sy AS (SELECT d, h, sum(a) AS xa, sum(b) AS xb, sum(p) AS xp, stddev_samp(a) AS sa, stddev_samp(b) AS sb, stddev_samp(p) AS sp FROM nq GROUP BY 1, 2)
SELECT CAST(CAST({bf_sql('2001')} AS TIMESTAMP) + to_hours(CAST(24 * d + h AS INTEGER)) AS VARCHAR) AS dtt, round(xa / sum(xa) OVER (), 6) AS norm_gtv_after, round(sa, 6) AS std_gtv_after,
  round(xb / sum(xb) OVER (), 6) AS norm_gtv_before, round(sb, 6) AS std_gtv_before, round(xp / sum(xp) OVER (), 6) AS norm_purchases, round(sp, 6) AS std_purchases FROM sy""")
def d51(t):
    out = S.hourly_event_share(hourly_sales(t), 2001)
    return rounded(as_text(out, "dtt"), *[c for c in out.columns if c != "dtt"])


@query("d51_share_by_year", f"""WITH {HOURLY}, gd AS (SELECT y, d, h, sum(ga) AS gtv, CAST(sum(CASE WHEN ga <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS p FROM hd WHERE d BETWEEN -1 AND 5 AND y >= 1996 GROUP BY 1, 2, 3)
SELECT y, d, h, CAST(gtv AS DOUBLE) AS gtv, p, round(CAST(gtv AS DOUBLE) / nullif(CAST(sum(gtv) OVER (PARTITION BY y) AS DOUBLE), 0), 6) AS n_gtv, round(d + h / 24, 6) AS x FROM gd""")
def d51_year(t):
    return rounded(S.hourly_share_by_year(hourly_sales(t), 1996), "gtv", "n_gtv", "x")


@query("d52_daily_sku_sales", """SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS sale_date, p_brand AS sku_config, count(*) AS sales, round(CAST(avg(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 4) AS avg_price,
  max(p_type) AS category, max(p_name) AS business_unit, max(p_size) AS division, week(CAST(l_shipdate AS DATE)) AS weekofyear, dayofweek(CAST(l_shipdate AS DATE)) AS dayofweek,
  date_diff('day', date_trunc('week', date_trunc('month', CAST(l_shipdate AS DATE))), date_trunc('week', CAST(l_shipdate AS DATE))) // 7 + 1 AS weekofmonth, year(l_shipdate) AS year
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey WHERE l_quantity <> 0 AND CAST(l_shipdate AS DATE) > DATE '1996-01-01' GROUP BY CAST(l_shipdate AS DATE), year(l_shipdate), p_brand""")
def d52(t):
    s = t.lineitem.select(F.to_date("l_shipdate").alias("sale_date"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("qty"),
                          F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    p = t.part.select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("sku_config"), F.col("p_type").alias("category"),
                      F.col("p_name").alias("business_unit"), F.col("p_size").alias("division"))
    return rounded(as_text(S.daily_sku_sales(s, p, "1996-01-01"), "sale_date"), "avg_price", digits=4)
