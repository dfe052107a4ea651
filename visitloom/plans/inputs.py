"""Shape the given tables into the inputs the operators expect, and the same in oracle SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.session import tune


class Tables:
    """Lazy parquet readers: ``t.orders``, ``t.events``, ..."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def epoch(ts) -> F.Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


BRAND = "brandx"

# ---------------------------------------------------------------- touches
def touches_in(t: Tables) -> DataFrame:
    e = t.events
    return e.select(
        "event_id",
        F.col("user_id").cast("string").alias("fvid"),
        F.when(F.col("event_id") % 2 == 0, "app").otherwise("site").alias("datasource"),
        F.when(F.col("event_id") % 3 == 0, F.md5(F.col("user_id").cast("string"))).alias("hash_id"),
        epoch("ts").alias("sess"),
        (epoch("ts") + 60 * F.regexp_extract("props", "([0-9]+)", 1).cast("long")).alias("sess_end"),
        F.col("event_type").alias("medium"),
        F.concat(F.lit("src"), (F.col("event_id") % 4).cast("string")).alias("src"),
        F.when(F.col("event_id") % 5 == 0, 1).otherwise(0).alias("is_some_kw"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("is_conversion"),
        F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(18,2)")).alias("value"),
    )


TOUCHES = """
SELECT event_id, CAST(user_id AS VARCHAR) AS fvid,
  CASE WHEN event_id % 2 = 0 THEN 'app' ELSE 'site' END AS datasource,
  CASE WHEN event_id % 3 = 0 THEN md5(CAST(user_id AS VARCHAR)) END AS hash_id,
  CAST(floor(epoch(ts)) AS BIGINT) AS sess,
  CAST(floor(epoch(ts)) AS BIGINT) + 60 * CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS sess_end,
  event_type AS medium, concat('src', CAST(event_id % 4 AS VARCHAR)) AS src,
  CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS is_some_kw,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_conversion,
  CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END AS value
FROM events"""


# ---------------------------------------------------------------- nested sessions
def sessions_in(t: Tables) -> DataFrame:
    """The nested visit record, one row per event."""
    e, i, u = t.events, F.col("event_id"), F.col("user_id").cast("string")
    dev = F.md5(F.concat(F.lit("d"), (F.col("user_id") % 40).cast("string")))
    uuid = F.concat_ws("-", F.substring(dev, 1, 8), F.substring(dev, 9, 4), F.substring(dev, 13, 4),
                       F.substring(dev, 17, 4), F.substring(dev, 21, 12))
    cd8 = (F.when(i % 3 == 0, F.md5(u)).when(i % 7 == 0, u).when(i % 5 == 0, "guest"))
    dims = F.array(F.struct(F.lit(8).alias("index"), cd8.alias("value")),
                   F.struct(F.lit(23).alias("index"), F.when(i % 11 != 0, uuid).alias("value")))
    kind = F.col("event_type")
    action = (F.when(kind == "purchase", "6").when(kind == "view", "2").when(kind == "click", "1")
              .when(kind == "signup", "3").otherwise("4"))
    hit = lambda act, page, prods: F.struct(
        F.struct(act.alias("action_type")).alias("eCommerceAction"),
        F.struct(page.alias("pagePath")).alias("page"), prods.alias("product"))
    no_product = F.array(F.struct(F.lit(True).alias("isImpression")))
    shown = lambda flag: F.struct(F.lit(flag).alias("isImpression"))
    several = F.concat(F.array_repeat(shown(True), (1 + i % 3).cast("int")), F.array_repeat(shown(False), (i % 4).cast("int")))
    hits = F.array(
        hit(F.lit("0"), F.when(i % 2 == 1, F.when(i % 3 == 1, "/").otherwise("/home")).otherwise("/"),
            no_product),
        hit(action, F.concat(F.lit("/p/"), (i % 9).cast("string")), several))
    return e.select(
        i.alias("visit_id"),
        F.when(i % 2 == 0, "app").otherwise("site").alias("datasource"),
        u.alias("fullVisitorId"),
        epoch("ts").alias("visitStartTime"),
        F.struct((60 * F.regexp_extract("props", "([0-9]+)", 1).cast("long")).alias("timeOnSite"),
                 F.when(kind == "purchase", (F.col("value").cast("decimal(18,2)") * 1000000).cast("long"))
                 .alias("totalTransactionRevenue"),
                 F.when(kind == "error", 1).alias("bounces")).alias("totals"),
        dims.alias("customDimensions"),
        F.struct(F.concat(F.lit("Src;"), (i % 4).cast("string")).alias("source"),
                 F.when(i % 13 != 0, kind).alias("medium"),
                 F.when(i % 5 == 0, f"{BRAND} shoes").when(i % 5 == 1, "red shoes").alias("keyword"),
                 F.when(i % 6 != 0, F.concat(F.lit("c"), (i % 6).cast("string"))).alias("campaign"),
                 F.when(i % 2 == 0, "ad1").alias("adContent"),
                 (i % 8 < 4).alias("isTrueDirect")).alias("trafficSource"),
        F.struct(F.when(i % 2 == 0, "mobile").otherwise("desktop").alias("deviceCategory")).alias("device"),
        F.struct(F.when(F.col("user_id") % 10 == 0, "Chile").otherwise("Brazil").alias("country"),
                 F.concat(F.lit("State "), (F.col("user_id") % 27).cast("string")).alias("region"))
        .alias("geoNetwork"),
        hits.alias("hits"),
        F.date_format("ts", "yyyyMMdd").alias("dt"),
    )


# flat form of the same records: what D01 must produce from the nested ones
SESSIONS_FLAT = f"""
SELECT event_id AS visit_id,
  CASE WHEN event_id % 2 = 0 THEN 'app' ELSE 'site' END AS datasource,
  CAST(user_id AS VARCHAR) AS fvid,
  CAST(floor(epoch(ts)) AS BIGINT) AS sess,
  CAST(floor(epoch(ts)) AS BIGINT) + 60 * CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS sess_end,
  CASE WHEN event_id % 3 = 0 THEN md5(CAST(user_id AS VARCHAR)) WHEN event_id % 7 = 0 THEN CAST(user_id AS VARCHAR)
       WHEN event_id % 5 = 0 THEN 'guest' END AS cd8,
  CASE WHEN event_id % 2 = 0 AND event_id % 11 <> 0 THEN
    substr(md5('d' || CAST(user_id % 40 AS VARCHAR)),1,8) || '-' || substr(md5('d' || CAST(user_id % 40 AS VARCHAR)),9,4)
    || '-' || substr(md5('d' || CAST(user_id % 40 AS VARCHAR)),13,4) || '-' || substr(md5('d' || CAST(user_id % 40 AS VARCHAR)),17,4)
    || '-' || substr(md5('d' || CAST(user_id % 40 AS VARCHAR)),21,12) END AS device_id,
  CASE WHEN user_id % 10 = 0 THEN 'foreign_country' ELSE 'state ' || CAST(user_id % 27 AS VARCHAR) END AS state,
  md5(concat(CASE WHEN event_id % 6 <> 0 THEN 'c' || CAST(event_id % 6 AS VARCHAR) ELSE '_' END,
             'Src;' || CAST(event_id % 4 AS VARCHAR),
             CASE WHEN event_id % 13 <> 0 THEN event_type ELSE '_' END,
             CASE WHEN event_id % 5 = 0 THEN '{BRAND} shoes' WHEN event_id % 5 = 1 THEN 'red shoes' ELSE '_' END,
             CASE WHEN event_id % 2 = 0 THEN 'ad1' ELSE '_' END)) AS utm_hash,
  'src' || CAST(event_id % 4 AS VARCHAR) AS src,
  CASE WHEN event_id % 13 <> 0 THEN event_type END AS medium,
  CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS is_some_kw,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_conversion,
  CASE WHEN event_id % 8 < 4 THEN 1 ELSE 0 END AS is_true_direct,
  CASE WHEN event_id % 2 = 1 THEN CASE WHEN event_id % 3 = 1 THEN 1 ELSE 0 END END AS is_page_direct,
  CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END AS value
FROM events"""


# ---------------------------------------------------------------- retail facts
def gmv() -> F.Column:
    return (F.col("l_extendedprice").cast("decimal(18,2)")
            * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))
            ).cast("decimal(18,4)")


def items_in(t: Tables, *more: F.Column) -> DataFrame:
    """One row per sold item with its order, customer and product attributes, and ``more`` columns of the joined tables.

    ``nation`` is the only side with a fixed size; the other joins are left to the planner,
    which splits a hot order or part key at run time.
    """
    o, l, c, p, n = t.orders, t.lineitem, t.customer, t.part, t.nation
    k = F.col("o_orderkey")
    return (l.join(o, l.l_orderkey == o.o_orderkey)
            .join(c, c.c_custkey == o.o_custkey)
            .join(F.broadcast(n), n.n_nationkey == c.c_nationkey)
            .join(p, p.p_partkey == l.l_partkey)
            .select(
                F.col("o_custkey").alias("fk_customer"),
                k.alias("sale_order_store_number"),
                F.to_date("o_orderdate").alias("sale_date"),
                (k % 24).cast("int").alias("sale_hour"),
                F.when(F.col("o_orderstatus") != "P", 1).otherwise(0).alias("is_paid"),
                F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("is_canceled"),
                F.col("o_orderpriority").alias("device"),
                F.col("c_mktsegment").alias("channel"),
                F.col("n_name").alias("state"),
                F.col("p_partkey").alias("product_id"),
                F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
                F.when(F.col("p_size") % 2 == 0, 1).otherwise(0).alias("is_market_place"),
                F.to_date("l_shipdate").alias("delivered_date"),
                F.col("l_linenumber").alias("line_no"),
                gmv().alias("gmv"), *more))


GMV = ("CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l.l_discount AS DECIMAL(4,2)))"
       " AS DECIMAL(18,4))")
def items_sql(more: str = "") -> str:
    return f"""
SELECT o.o_custkey AS fk_customer, o.o_orderkey AS sale_order_store_number,
  CAST(o.o_orderdate AS DATE) AS sale_date, CAST(o.o_orderkey % 24 AS INT) AS sale_hour,
  CASE WHEN o.o_orderstatus <> 'P' THEN 1 ELSE 0 END AS is_paid,
  CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS is_canceled,
  o.o_orderpriority AS device, c.c_mktsegment AS channel, n.n_name AS state,
  p.p_partkey AS product_id, p.p_brand AS brand, p.p_type AS category,
  CASE WHEN p.p_size % 2 = 0 THEN 1 ELSE 0 END AS is_market_place,
  CAST(l.l_shipdate AS DATE) AS delivered_date, l.l_linenumber AS line_no, {GMV} AS gmv{more}
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN part p ON p.p_partkey = l.l_partkey"""


ITEMS = items_sql()


def customers_in(t: Tables) -> DataFrame:
    c, n = t.customer, t.nation
    return (c.join(F.broadcast(n), n.n_nationkey == c.c_nationkey, "left").select(
        F.col("c_custkey").alias("src_fk_customer"),
        F.md5(F.col("c_custkey").cast("string")).alias("id_hash"),
        F.when(F.col("c_custkey") % 3 == 0, "female").when(F.col("c_custkey") % 3 == 1, "male").alias("gender"),
        (1950 + F.col("c_custkey") % 50).cast("int").alias("birthday"),
        (2010 + F.col("c_custkey") % 12).cast("int").alias("cust_created_year"),
        F.lower("n_name").alias("country_region")))


CUSTOMERS = """
SELECT c.c_custkey AS src_fk_customer, md5(CAST(c.c_custkey AS VARCHAR)) AS id_hash,
  CASE c.c_custkey % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS gender,
  CAST(1950 + c.c_custkey % 50 AS INT) AS birthday,
  CAST(2010 + c.c_custkey % 12 AS INT) AS cust_created_year,
  lower(n.n_name) AS country_region
FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey"""


CATEGORIES = ["Canais Pagos", "Strategic Marketing BR", "Creative Marketing", "Trade Marketing X", "B2B Services", "Other"]


LEDGER_ROWS = 2_000_000     # a task groups at most about this many rows


def costs_in(t: Tables) -> DataFrame:
    """Marketing cost ledger rows, in ranges of the supplier.

    Ranges of all four keys serve the grouping, split a hot supplier, and keep rows with the same
    descriptions together: later sums by description shrink before they are shuffled.
    """
    l, s = t.lineitem, t.supplier
    keys = ["l_suppkey", "l_orderkey", "l_partkey", "l_linenumber"]
    key = F.concat_ws("-", *[F.col(c).cast("string")
                             for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    parts = math.ceil(l.count() / LEDGER_ROWS)
    few = parts <= int(t.spark.conf.get("spark.sql.shuffle.partitions"))     # then the planner may merge small ones
    l = (l.select(*keys, F.to_date("l_shipdate").alias("ship"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
         .repartitionByRange(*([] if few else [parts]), *keys))
    return (l.groupBy(*keys)
            .agg(F.max("ship").alias("cost_date"), F.sum("price").alias("value"))
            .join(s, s.s_suppkey == F.col("l_suppkey"))
            .select(key.alias("id_cost"), "cost_date",
                    F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(30).alias("cost_allocation"),
                    (F.col("l_linenumber") % 9).cast("int").alias("store_id"),
                    (F.col("l_partkey") % 14).cast("int").alias("device_id"),
                    (F.col("l_suppkey") % 9).cast("int").alias("currency_id"),
                    F.when(F.col("s_nationkey") != 4, F.col("s_nationkey")).cast("int").alias("country_id"),
                    F.concat(F.lit("entity"), (F.col("s_nationkey") % 4).cast("string")).alias("legal_entity_name"),
                    (F.col("l_partkey") % 8).cast("int").alias("gl_account_id"),
                    F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("l_partkey") % len(CATEGORIES) + 1).cast("int")).alias("category_name"),
                    F.col("s_name").alias("supplier_name"),
                    F.when(F.col("l_partkey") % 7 != 0, F.concat(F.lit("acc"), (F.col("l_partkey") % 7).cast("string")))
                    .alias("account_name"),
                    F.concat(F.lit("ch"), (F.col("l_suppkey") % 5).cast("string")).alias("channel_name"),
                    F.when(F.col("l_orderkey") % 3 == 0, "promo").alias("short_description"),
                    F.col("value").cast("decimal(18,2)").alias("value")))


COSTS = """
SELECT concat(CAST(l.l_orderkey AS VARCHAR), '-', CAST(l.l_partkey AS VARCHAR), '-', CAST(l.l_suppkey AS VARCHAR), '-', CAST(l.l_linenumber AS VARCHAR)) AS id_cost,
  CAST(max(l.l_shipdate) AS DATE) AS cost_date,
  CASE WHEN l.l_linenumber % 2 = 1 THEN 1 ELSE 30 END AS cost_allocation,
  CAST(l.l_linenumber % 9 AS INT) AS store_id, CAST(l.l_partkey % 14 AS INT) AS device_id,
  CAST(l.l_suppkey % 9 AS INT) AS currency_id, 
  CAST(CASE WHEN s.s_nationkey <> 4 THEN s.s_nationkey END AS INT) AS country_id, concat('entity', CAST(s.s_nationkey % 4 AS VARCHAR)) AS legal_entity_name,
  CAST(l.l_partkey % 8 AS INT) AS gl_account_id,
  ['Canais Pagos', 'Strategic Marketing BR', 'Creative Marketing', 'Trade Marketing X', 'B2B Services', 'Other'][l.l_partkey % 6 + 1] AS category_name,
  s.s_name AS supplier_name,
  CASE WHEN l.l_partkey % 7 <> 0 THEN concat('acc', CAST(l.l_partkey % 7 AS VARCHAR)) END AS account_name,
  concat('ch', CAST(l.l_suppkey % 5 AS VARCHAR)) AS channel_name,
  CASE WHEN l.l_orderkey % 3 = 0 THEN 'promo' END AS short_description,
  CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS value
FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey
GROUP BY l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, s.s_name, s.s_nationkey"""


def audience_in(t: Tables) -> DataFrame:
    o, k = t.orders, F.col("o_custkey")
    return o.groupBy("o_custkey").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("gtv"),
        F.count(F.lit(1)).alias("orders"),
        F.sum((F.col("o_orderkey") % 5).cast("long")).alias("items"),
        F.to_date(F.min("o_orderdate")).alias("first_interaction"),
        F.to_date(F.max("o_orderdate")).alias("last_seen"),
    ).select(
        F.concat(k.cast("string"), F.lit("-BR")).alias("external_user_id"),
        F.when(k % 2 == 0, "AND").otherwise("IOS").alias("os"),
        F.when(k % 5 == 0, 1).otherwise(0).alias("is_control"),
        "first_interaction",
        F.when(k % 4 == 0, F.col("last_seen")).alias("first_uninstall"),
        "gtv", "items", "orders")


AUDIENCE = """
SELECT concat(CAST(o_custkey AS VARCHAR), '-BR') AS external_user_id,
  CASE WHEN o_custkey % 2 = 0 THEN 'AND' ELSE 'IOS' END AS os,
  CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS is_control,
  CAST(min(o_orderdate) AS DATE) AS first_interaction,
  CASE WHEN o_custkey % 4 = 0 THEN CAST(max(o_orderdate) AS DATE) END AS first_uninstall,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS gtv,
  CAST(sum(o_orderkey % 5) AS BIGINT) AS items, count(*) AS orders
FROM orders GROUP BY o_custkey"""


def catalog_in(t: Tables) -> DataFrame:
    d, l = t.documents, t.labels
    return d.join(l, "doc_id", "left").select(
        F.col("doc_id").alias("product_id"), F.col("text").alias("product_description"),
        F.col("lang").alias("gender"), F.col("source").alias("brand"),
        F.col("n_chars").alias("price"),
        F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("category"))


CATALOG = """
SELECT d.doc_id AS product_id, d.text AS product_description, d.lang AS gender, d.source AS brand,
  d.n_chars AS price,
  CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'bad' END AS category
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"""
