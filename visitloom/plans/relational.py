"""The relational constructs, one query each, written as a Spark user writes them."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.functions import columns as X
from visitloom.functions.ordered import lay_track, lift_off, quantiles, scan, spread, split_rank
from visitloom.operators import catalog as C
from visitloom.operators import markov as M
from visitloom.operators import rollups as G
from visitloom.operators.ml import evaluate as V
from visitloom.plans import inputs as N
from visitloom.plans.journeys import MEDIUM_EDGES, STATES, medium_edges
from visitloom.plans.registry import as_text, query, rounded
from visitloom.plans.retail import bf_sql, since_bf_sql
from visitloom.session import store
from visitloom.sources import readers as R
from visitloom.sources import schemas as Z
from visitloom.sources import writers as O

c, lit = F.col, F.lit
D2 = "decimal(18,2)"
money = lambda name: F.col(name).cast(D2)
total = lambda e, name: F.sum(e).cast("double").alias(name)


def q(name, sql, fn):
    query(name, sql)(fn)


# ------------------------------------------------------------------ sources that are plain queries
q("s01_scan_sessions", "SELECT event_id, strftime(ts, '%Y%m%d') AS dt FROM events WHERE strftime(ts, '%Y%m%d') BETWEEN '20240103' AND '20240105' OR strftime(ts, '%Y%m%d') = '20240110' OR strftime(ts, '%Y%m%d') >= '20240128'",
  lambda t: R.scan_sessions(t.events.select("event_id", F.date_format("ts", "yyyyMMdd").alias("dt")), [[20240105, 20240103], [20240110], [20240128, 0]]))

q("s07_conform", "SELECT CAST(n_nationkey AS VARCHAR) AS id, TRY_CAST(n_name AS INTEGER) AS name, CAST(n_regionkey AS DOUBLE) AS region FROM nation",
  lambda t: Z.conform(t.nation, [("id", "string"), ("name", "int"), ("region", "double")]))


def s11(t):
    """Temporary tables by names of their own, so that several runs of one session do not replace each other's."""
    paid, per = (f"visitloom_{uuid.uuid4().hex}" for _ in range(2))
    t.orders.filter(c("o_orderstatus") == "F").createOrReplaceTempView(paid)
    t.spark.sql(f"SELECT o_custkey, count(*) AS n FROM {paid} GROUP BY o_custkey").createOrReplaceTempView(per)
    return t.spark.sql(f"SELECT p.o_orderkey, c.n FROM {paid} p JOIN {per} c ON c.o_custkey = p.o_custkey WHERE c.n > 3")


q("s11_temp_tables", "WITH paid AS (SELECT * FROM orders WHERE o_orderstatus = 'F'), per AS (SELECT o_custkey, count(*) AS n FROM paid GROUP BY 1) SELECT o_orderkey, n FROM paid JOIN per USING (o_custkey) WHERE n > 3", s11)

q("s16_latest_run", "SELECT 'run-' || strftime(max(date_trunc('second', ts)), '%Y-%m-%d-%H-%M-%S') AS run, CAST(max(date_trunc('second', ts)) AS VARCHAR) AS at FROM events",
  lambda t: as_text(R.latest_run(t.events.select(F.concat(lit("run-"), F.date_format("ts", "yyyy-MM-dd-HH-mm-ss")).alias("name")), "name"), "at"))

q("s17_resume_queue", "SELECT p_partkey, 'done' AS status FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT DISTINCT l_partkey, 'pending' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)",
  lambda t: R.resume_queue(t.lineitem.select(c("l_partkey").alias("p_partkey")), t.part.filter("p_partkey % 3 = 0").select("p_partkey", lit("done").alias("status")), "p_partkey"))

# ------------------------------------------------------------------ projections and predicates
q("p01_except_columns", "SELECT * EXCLUDE (n_regionkey) FROM nation", lambda t: t.nation.drop("n_regionkey"))
q("p02_lateral_alias", "SELECT o_orderkey, year(o_orderdate) AS y, year(o_orderdate) * 2 AS y2 FROM orders WHERE year(o_orderdate) > 1997",
  lambda t: t.orders.withColumn("y", F.year("o_orderdate")).filter("y > 1997").selectExpr("o_orderkey", "y", "y * 2 AS y2"))
q("p03_recode", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band, CASE p_size WHEN 1 THEN 352 WHEN 3 THEN 219 WHEN 5 THEN 21 ELSE 0 END AS mapped FROM part",
  lambda t: t.part.select("p_partkey", F.when(c("p_size") < 10, "small").when(c("p_size") < 30, "medium").otherwise("large").alias("band"), X.recode("p_size", {1: 352, 3: 219, 5: 21}, 0).alias("mapped")))
q("p04_between_in", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus IN ('F','O') AND o_orderpriority NOT IN ('1-URGENT') AND o_orderdate IS NOT NULL AND o_custkey <> 7",
  lambda t: t.orders.filter(c("o_totalprice").between(1000, 200000) & c("o_orderstatus").isin("F", "O") & ~c("o_orderpriority").isin("1-URGENT") & c("o_orderdate").isNotNull() & (c("o_custkey") != 7)).select("o_orderkey"))
q("p05_like", "SELECT p_partkey FROM part WHERE p_name LIKE 'small%' OR p_name LIKE '%widget%' OR p_brand LIKE 'Brand#1'",
  lambda t: t.part.filter(c("p_name").startswith("small") | c("p_name").contains("widget") | c("p_brand").like("Brand#1")).select("p_partkey"))
q("p06_length", "SELECT p_partkey FROM part WHERE length(p_name) > 10 AND length(p_brand) = 8", lambda t: t.part.filter((F.length("p_name") > 10) & (F.length("p_brand") == 8)).select("p_partkey"))
q("p07_dropna", "SELECT event_id, value FROM events WHERE value IS NOT NULL AND event_type = 'purchase' AND value > 10", lambda t: t.events.na.drop(subset=["value"]).filter("event_type = 'purchase' AND value > 10").select("event_id", "value"))
_hole = lambda t: t.orders.select("o_orderkey", F.when(c("o_orderkey") % 3 != 0, c("o_custkey")).alias("a"), F.when(c("o_orderkey") % 2 != 0, c("o_orderpriority")).alias("b"))
_HOLE = "(SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS a, CASE WHEN o_orderkey % 2 <> 0 THEN o_orderpriority END AS b FROM orders)"
q("p08_fill", f"SELECT o_orderkey, coalesce(a, -1) AS a, coalesce(b, 'none') AS b FROM {_HOLE}", lambda t: _hole(t).na.fill({"a": -1, "b": "none"}))
q("p09_blank_unknown", "SELECT p_partkey, CASE WHEN s = ' ' THEN 'Unknown' ELSE s END AS s FROM (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN ' ' ELSE p_type END AS s FROM part)",
  lambda t: t.part.select("p_partkey", F.when(c("p_size") % 4 == 0, " ").otherwise(c("p_type")).alias("s")).withColumn("s", F.when(c("s") == " ", "Unknown").otherwise(c("s"))))
q("p10_identified", "SELECT event_id FROM events WHERE NOT contains(CASE WHEN event_id % 3 = 0 THEN 'app:' ELSE '' END || CAST(user_id AS VARCHAR), ':')",
  lambda t: t.events.withColumn("gid", F.concat(F.when(c("event_id") % 3 == 0, "app:").otherwise(""), c("user_id").cast("string"))).filter(~c("gid").contains(":")).select("event_id"))
q("p11_split_key", f"WITH a AS ({N.AUDIENCE}) SELECT external_user_id, split_part(external_user_id, '-', 1) AS fk_customer, split_part(external_user_id, '-', 2) AS country FROM a",
  lambda t: __import__("visitloom.operators.costs", fromlist=["x"]).split_user_key(N.audience_in(t)).select("external_user_id", "fk_customer", "country"))

# ------------------------------------------------------------------ joins
q("j01_inner", "SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey", lambda t: t.customer.join(t.nation, c("n_nationkey") == c("c_nationkey")).select("c_custkey", "n_name"))


def j02(t):
    a = t.lineitem.groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.count(lit(1)).alias("n"))
    b = t.lineitem.groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(total(money("l_extendedprice"), "v"))
    return a.join(b, ["l_orderkey", "l_partkey", "l_suppkey"])


q("j02_composite_keys", "SELECT l_orderkey, l_partkey, l_suppkey, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2, 3", j02)
q("j03_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON o_custkey = c_custkey",
  lambda t: t.customer.join(t.orders.filter("o_orderstatus = 'P'"), c("o_custkey") == c("c_custkey"), "left").select("c_custkey", "o_orderkey"))


def j04(t):
    dim = t.nation.select("n_nationkey", "n_name").dropDuplicates(["n_nationkey"])
    a, b = dim.toDF("k1", "name1"), dim.toDF("k2", "name2")
    return (t.supplier.join(a, c("k1") == F.when(c("s_suppkey") % 2 == 0, c("s_nationkey")), "left").join(b, c("k2") == c("s_suppkey") % 25, "left")
            .select("s_suppkey", F.coalesce("name1", "name2", lit("?")).alias("name")))


q("j04_two_key_lookup", "SELECT s_suppkey, coalesce(a.n_name, b.n_name, '?') AS name FROM supplier LEFT JOIN nation a ON a.n_nationkey = CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END LEFT JOIN nation b ON b.n_nationkey = s_suppkey % 25", j04)
_halves = lambda t: (t.orders.filter("o_orderkey % 2 = 0").groupBy(c("o_custkey").alias("k")).agg(F.count(lit(1)).alias("a")),
                     t.orders.filter("o_orderkey % 5 = 0").groupBy(c("o_custkey").alias("k")).agg(F.count(lit(1)).alias("b")))
_HALVES = "x AS (SELECT o_custkey AS k, count(*) AS a FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), y AS (SELECT o_custkey AS k, count(*) AS b FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1)"
q("j05_full_outer", f"WITH {_HALVES} SELECT k, a, b FROM x FULL JOIN y USING (k) WHERE length(CAST(a AS VARCHAR)) > 0", lambda t: _halves(t)[0].join(_halves(t)[1], "k", "full").filter(F.length(c("a").cast("string")) > 0))
q("j06_side_indicator", f"WITH {_HALVES} SELECT k, a, b, CASE WHEN a IS NULL THEN 'right_only' WHEN b IS NULL THEN 'left_only' ELSE 'both' END AS side FROM x FULL JOIN y USING (k)",
  lambda t: _halves(t)[0].join(_halves(t)[1], "k", "full").withColumn("side", F.when(c("a").isNull(), "right_only").when(c("b").isNull(), "left_only").otherwise("both")))
q("j07_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", lambda t: t.customer.join(t.orders.filter("o_totalprice > 400000"), c("o_custkey") == c("c_custkey"), "left_semi").select("c_custkey"))
q("j08_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", lambda t: t.customer.join(t.orders.filter("o_totalprice > 400000"), c("o_custkey") == c("c_custkey"), "left_anti").select("c_custkey"))
q("j09_left_not_null", "SELECT o_orderkey, p_name FROM orders LEFT JOIN part ON p_partkey = o_custkey * 2 WHERE p_partkey IS NOT NULL", lambda t: t.orders.join(t.part, c("p_partkey") == c("o_custkey") * 2, "inner").select("o_orderkey", "p_name"))


def j10(t):
    labels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    hashed = t.orders.select("o_orderkey", F.sha1(F.concat(c("o_orderkey").cast("string"), lit("|"), c("o_orderpriority"))).alias("h"))
    hit = F.filter(F.array(*[lit(x) for x in labels]), lambda x: F.sha1(F.concat(c("o_orderkey").cast("string"), lit("|"), x)) == c("h"))
    return hashed.select("o_orderkey", F.get(hit, lit(0)).alias("label"))


q("j10_digest_lookup", "SELECT o_orderkey, o_orderpriority AS label FROM orders", j10)
q("j11_complete_pairs", f"WITH {MEDIUM_EDGES}, s AS (SELECT unnest([{', '.join(repr(x) for x in STATES + ['END'])}]) AS st) SELECT a.st AS from_state, b.st AS to_state, coalesce(cnt, 0) AS cnt FROM s a CROSS JOIN s b LEFT JOIN edges ON from_state = a.st AND to_state = b.st",
  lambda t: M.complete(medium_edges(t), STATES + ["END"]))


def j12(t):
    months = t.orders.groupBy(F.to_date(F.trunc("o_orderdate", "month")).alias("m")).agg(total(money("o_totalprice"), "v"))
    return as_text(months.select(F.explode(F.sequence("m", F.last_day("m"))).alias("day"), "v"), "day")


q("j12_month_to_days", "WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY 1) SELECT CAST(CAST(unnest(generate_series(m, m + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS day, v FROM m", j12)
q("j13_scalar_subquery", "SELECT o_orderkey FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,2)) > 0.9 * (SELECT max(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders)",
  lambda t: t.orders.filter(money("o_totalprice") > t.orders.agg(F.max(money("o_totalprice"))).scalar() * lit(0.9).cast("decimal(2,1)")).select("o_orderkey"))
q("j14_array_subquery", "SELECT event_id AS visit_id, CASE WHEN event_id % 3 = 0 THEN md5(CAST(user_id AS VARCHAR)) WHEN event_id % 7 = 0 THEN CAST(user_id AS VARCHAR) WHEN event_id % 5 = 0 THEN 'guest' END AS v, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS n FROM events",
  lambda t: N.sessions_in(t).select("visit_id", X.keyed("customDimensions", 8).alias("v"), X.count_where("hits", lambda h: h["eCommerceAction"]["action_type"] == "6").alias("n")))
q("j15_two_level_unnest", "SELECT event_id AS visit_id, 2 + event_id % 3 AS products, 2 + event_id % 3 + event_id % 4 AS shown FROM events",
  lambda t: N.sessions_in(t).select("visit_id", F.explode("hits").alias("h")).select("visit_id", F.explode("h.product").alias("p")).groupBy("visit_id").agg(F.count_if(c("p.isImpression")).alias("products"), F.count(lit(1)).alias("shown")))
q("j16_unnest_offset", "SELECT doc_id, i - 1 AS off, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(lang || ' ' || source, ' ') AS w FROM documents))",
  lambda t: t.documents.select("doc_id", F.posexplode(F.split(F.concat_ws(" ", "lang", "source"), " ")).alias("off", "word")))
q("j17_group_total", "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey) AS DOUBLE) AS t FROM orders",
  lambda t: spread(t.orders.select("o_orderkey", "o_custkey", money("o_totalprice").alias("v")), ["o_custkey"], t=F.sum("v")).select("o_orderkey", c("t").cast("double").alias("t")))
q("j18_align_runs", f"WITH {_HALVES} SELECT k AS medium, CAST(coalesce(a, 0) AS DOUBLE) AS r1, CAST(coalesce(b, 0) AS DOUBLE) AS r2, CAST(coalesce(a, 0) + coalesce(b, 0) AS DOUBLE) AS total FROM x FULL JOIN y USING (k)",
  lambda t: __import__("visitloom.operators.attribution", fromlist=["x"]).compare_runs({"r1": _halves(t)[0].select(c("k").alias("medium"), c("a").cast("double").alias("v")), "r2": _halves(t)[1].select(c("k").alias("medium"), c("b").cast("double").alias("v"))}, "v"))
def j19(t):
    """Equal amounts, to the cent, of different orders of a customer."""
    side = lambda key: t.orders.select(c("o_orderkey").alias(key), "o_custkey", (money("o_totalprice") * 100).cast("bigint").alias("cents"))
    return side("a_key").join(side("b_key"), ["o_custkey", "cents"]).filter("a_key <= b_key").select("a_key", "b_key")


q("j19_join_on_amount", "SELECT a.o_orderkey AS a_key, b.o_orderkey AS b_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND CAST(a.o_totalprice AS DECIMAL(18,2)) = CAST(b.o_totalprice AS DECIMAL(18,2)) AND a.o_orderkey <= b.o_orderkey", j19)

# ------------------------------------------------------------------ aggregates
q("a01_group_agg", "SELECT o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s, count(*) AS n, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS a, min(o_custkey) AS lo, max(o_custkey) AS hi FROM orders GROUP BY 1",
  lambda t: t.orders.groupBy("o_orderstatus").agg(total(money("o_totalprice"), "s"), F.count(lit(1)).alias("n"), F.round(F.sum(money("o_totalprice")).cast("double") / F.count(lit(1)), 4).alias("a"), F.min("o_custkey").alias("lo"), F.max("o_custkey").alias("hi")))
q("a02_flag_agg", "SELECT o_custkey, CASE WHEN sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) > 0 THEN 1 ELSE 0 END AS urgent FROM orders GROUP BY 1",
  lambda t: t.orders.groupBy("o_custkey").agg(F.max(F.when(c("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("urgent")))


TEXT_PART = 100_000                # pieces of one text value; a longer list continues in the next part


def a03(t):
    laid, track = lay_track(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    placed = lift_off(scan(laid, track, rn=("row_number", None))).withColumn("part", F.floor((c("rn") - 1) / TEXT_PART))
    return placed.groupBy("o_custkey", "part").agg(F.expr("listagg(o_orderstatus, ',') WITHIN GROUP (ORDER BY rn)").alias("statuses"))


q("a03_string_agg", f"""SELECT o_custkey, CAST((rn - 1) // {TEXT_PART} AS BIGINT) AS part, string_agg(o_orderstatus, ',' ORDER BY rn) AS statuses
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) GROUP BY 1, 2""", a03)


def a04(t):
    when = F.struct("o_orderdate", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(F.count(lit(1)).alias("n"), F.min_by("o_orderkey", when).alias("first_key"), F.max_by("o_orderstatus", when).alias("last_status"))


q("a04_struct_agg", "SELECT o_custkey, count(*) AS n, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_key, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_status FROM orders GROUP BY 1", a04)
q("a05_any_value", "SELECT o_custkey, min(o_orderpriority) AS any_priority, arg_min(o_orderstatus, o_orderkey) AS first_status FROM orders GROUP BY 1", lambda t: t.orders.groupBy("o_custkey").agg(F.min("o_orderpriority").alias("any_priority"), F.min_by("o_orderstatus", "o_orderkey").alias("first_status")))
q("a06_distinct", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders", lambda t: t.orders.select("o_custkey", "o_orderstatus").distinct())
q("a06_keep_first", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1", lambda t: t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")))
q("a07_distinct_count", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1", lambda t: t.orders.groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers")))


_RANGE = "BETWEEN DATE '1995-03-10' AND DATE '1997-02-20'"


def _daily(t):
    o = t.orders.select(F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority", "o_custkey", c("o_totalprice").cast("double").alias("price"))
    return o, store(G.daily_sketches(o, "day", ["o_orderpriority"], "o_custkey", "price"))


def a07_rollup(t):
    """Distinct customers of a date range from daily sketches, with the exact count and whether the bound holds."""
    o, sketches = _daily(t)
    days = F.expr(f"day {_RANGE}")
    both = G.roll_up(sketches, ["o_orderpriority"], days).join(G.exact(o.filter(days), ["o_orderpriority"], "o_custkey"), "o_orderpriority")
    return both.select("o_orderpriority", "n", "distinct_exact", (F.abs(c("n_distinct") / c("distinct_exact") - 1) <= G.distinct_error()).alias("within"))


q("a07_daily_rollup", f"SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS distinct_exact, true AS within FROM orders WHERE CAST(o_orderdate AS DATE) {_RANGE} GROUP BY 1", a07_rollup)


def a10_rollup(t):
    """Median of a date range from daily sketches; within: its exact rank lies within 2 % of the middle."""
    o, sketches = _daily(t)
    days = F.expr(f"day {_RANGE}")
    found = F.broadcast(G.roll_up(sketches, ["o_orderpriority"], days).select("o_orderpriority", "q0"))     # one row per priority
    ranks = o.filter(days).join(found, "o_orderpriority").groupBy("o_orderpriority").agg(
        F.count(lit(1)).alias("n"), (F.abs(F.count_if(c("price") <= c("q0")) / F.count(lit(1)) - 0.5) <= 0.02).alias("within"))
    return ranks


q("a10_daily_rollup", f"SELECT o_orderpriority, count(*) AS n, true AS within FROM orders WHERE CAST(o_orderdate AS DATE) {_RANGE} GROUP BY 1", a10_rollup)
q("a08_value_counts", "WITH n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT p_brand, n, round(n / sum(n) OVER (), 6) AS share, round(sum(n) OVER (ORDER BY n DESC, p_brand) / sum(n) OVER (), 6) AS cum_share FROM n",
  lambda t: rounded(C.value_shares(t.part, "p_brand"), "share", "cum_share"))
q("a09_stddev", "SELECT o_orderstatus, round(stddev_samp(o_custkey), 4) AS s FROM orders GROUP BY 1", lambda t: rounded(t.orders.groupBy("o_orderstatus").agg(F.stddev_samp("o_custkey").alias("s")), "s", digits=4))
q("a10_quantiles", "SELECT o_orderstatus, " + ", ".join(f"round(quantile_cont(o_totalprice, {p}), 3) AS q{i}" for i, p in enumerate([0.1, 0.25, 0.5, 0.75, 0.9])) + " FROM orders GROUP BY 1",
  lambda t: rounded(quantiles(t.orders, "o_totalprice", [0.1, 0.25, 0.5, 0.75, 0.9], ["o_orderstatus"]), "q0", "q1", "q2", "q3", "q4", digits=3))
q("a11_mode", "SELECT p_type AS mode FROM part GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 1", lambda t: C.mode_of(t.part, "p_type").toDF("mode"))
q("a12_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1",
  lambda t: t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(lit(1))).na.fill(0))
q("a13_multi_agg", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS size_sum, count(p_size) AS size_count, max(p_size) AS size_max FROM part GROUP BY 1", lambda t: t.part.groupBy("p_brand").agg(F.sum("p_size").alias("size_sum"), F.count("p_size").alias("size_count"), F.max("p_size").alias("size_max")))
q("a14_inverted_map", "SELECT p_type, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part GROUP BY 1",
  lambda t: t.part.select("p_type", "p_brand").distinct().groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_list("p_brand")), ",").alias("brands")))


def a15(t):
    """The hits of each session by action type, as one array of (type, number), ordered by type."""
    types = F.transform("hits", lambda h: h["eCommerceAction"]["action_type"])
    groups = F.transform(F.array_sort(F.array_distinct(F.filter(types, lambda x: x.isNotNull()))), lambda k: F.concat(k, F.lit(":"), F.size(F.filter(types, lambda x: x == k)).cast("string")))
    return N.sessions_in(t).select("visit_id", F.array_join(groups, ",").alias("actions"))


q("a15_group_in_array", """SELECT event_id AS visit_id, '0:1,' || CASE event_type WHEN 'purchase' THEN '6' WHEN 'view' THEN '2' WHEN 'click' THEN '1' WHEN 'signup' THEN '3' ELSE '4' END || ':1' AS actions FROM events""", a15)
q("a16_share_of_total", "WITH s AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) SELECT c_mktsegment, round(n / sum(n) OVER (), 6) AS share FROM s",
  lambda t: t.customer.groupBy("c_mktsegment").agg(F.count(lit(1)).alias("n")).select("c_mktsegment", F.round(c("n") / F.sum("n").over(W.partitionBy()), 6).alias("share")))
q("a17_top_categories", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 5", lambda t: t.part.groupBy("p_brand").agg(F.count(lit(1)).alias("n")).orderBy(c("n").desc(), "p_brand").limit(5))

# ------------------------------------------------------------------ windows
_OW = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_ev = lambda t: N.touches_in(t).select("event_id", "fvid", "sess", "sess_end", "medium", "hash_id", "is_conversion")
_EV = f"tt AS ({N.TOUCHES})"
_TW = "PARTITION BY fvid ORDER BY sess, event_id"


def over_orders(t, **outputs):
    base = t.orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"), money("o_totalprice").alias("v"))
    laid, track = lay_track(base, ["o_custkey"], ["d", "o_orderkey"])
    return lift_off(scan(laid, track, **outputs))


def over_touches(t, **outputs):
    laid, track = lay_track(_ev(t), ["fvid"], ["sess", "event_id"])
    return lift_off(scan(laid, track, **outputs))


q("w01_prior_sum", f"WITH {_EV} SELECT event_id, CAST(coalesce(sum(is_conversion) OVER ({_TW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS prior FROM tt",
  lambda t: over_touches(t, prior=("prior_sum", "is_conversion")).select("event_id", "prior"))
q("w02_next_known", f"WITH {_EV} SELECT event_id, first_value(hash_id IGNORE NULLS) OVER ({_TW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM tt",
  lambda t: over_touches(t, nxt=("next_known", "hash_id")).select("event_id", "nxt"))
q("w03_last_known", f"WITH {_EV} SELECT event_id, last_value(hash_id IGNORE NULLS) OVER ({_TW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prev FROM tt",
  lambda t: over_touches(t, prev=("last_known", "hash_id")).select("event_id", "prev"))
q("w04_spread_id", f"WITH {_EV} SELECT event_id, min(hash_id) OVER (PARTITION BY fvid) AS known FROM tt", lambda t: spread(_ev(t), ["fvid"], known=F.min("hash_id")).select("event_id", "known"))
q("w05_lag_gap", f"WITH {_EV} SELECT event_id, sess - lag(sess_end) OVER ({_TW}) AS gap FROM tt", lambda t: over_touches(t, prev=("lag", "sess_end")).select("event_id", (c("sess") - c("prev")).alias("gap")))
q("w06_lead_default", f"WITH {_EV} SELECT event_id, coalesce(lead(medium) OVER ({_TW}), CASE WHEN is_conversion = 1 THEN 'CONVERSION' ELSE 'END' END) AS nxt FROM tt",
  lambda t: over_touches(t, nxt=("lead", "medium")).select("event_id", F.coalesce("nxt", F.when(c("is_conversion") == 1, "CONVERSION").otherwise("END")).alias("nxt")))
q("w07_max_over_group", f"WITH {_EV} SELECT event_id, max(is_conversion) OVER (PARTITION BY fvid, medium) AS m FROM tt", lambda t: spread(_ev(t), ["fvid", "medium"], m=F.max("is_conversion")).select("event_id", "m"))
q("w08_first_nth", f"SELECT DISTINCT o_custkey, first_value(o_orderkey) OVER ({_OW} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS k1, nth_value(o_orderkey, 2) OVER ({_OW} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS k2 FROM orders",
  lambda t: over_orders(t, rn=("row_number", None)).groupBy("o_custkey").agg(F.min(F.when(c("rn") == 1, c("o_orderkey"))).alias("k1"), F.min(F.when(c("rn") == 2, c("o_orderkey"))).alias("k2")))
q("w09_last_value", f"SELECT DISTINCT o_custkey, last_value(o_orderstatus) OVER ({_OW} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_status FROM orders",
  lambda t: t.orders.groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last_status")))


def w10(t):
    days = t.orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("d")).agg(F.count(lit(1)).alias("n"))
    laid, track = lay_track(days, ["o_custkey"], ["d"])
    return as_text(lift_off(scan(laid, track, before=("prior_sum", "n"))).select("o_custkey", "d", (c("before") + 1).alias("rk")), "d")


q("w10_rank", "SELECT DISTINCT o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)) AS rk FROM orders", w10)
q("w10_nth_weekday", "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE month(o_orderdate) = 11 AND isodow(o_orderdate) = 4) SELECT CAST(d AS VARCHAR) AS d, rank() OVER (PARTITION BY year(d) ORDER BY day(d)) AS rk FROM d",
  lambda t: as_text(t.orders.select(F.to_date("o_orderdate").alias("d")).filter((F.month("d") == 11) & (F.weekday("d") == 3)).distinct().withColumn("rk", F.rank().over(W.partitionBy(F.year("d")).orderBy(F.dayofmonth("d")))), "d"))
q("w11_normalise", "WITH g AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2) SELECT y, m, round(n / sum(n) OVER (PARTITION BY y), 6) AS in_year, round(n / sum(n) OVER (), 6) AS overall FROM g",
  lambda t: t.orders.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count(lit(1)).alias("n")).select("y", "m", F.round(c("n") / F.sum("n").over(W.partitionBy("y")), 6).alias("in_year"), F.round(c("n") / F.sum("n").over(W.partitionBy()), 6).alias("overall")))
q("w12_days_in_month", "SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, day(last_day(o_orderdate)) AS days FROM orders", lambda t: as_text(t.orders.select(F.to_date("o_orderdate").alias("d")).distinct().withColumn("days", F.dayofmonth(F.last_day("d"))), "d"))
q("w13_shift", f"SELECT o_orderkey, lag(o_orderkey) OVER ({_OW}) AS prev, lead(o_orderkey) OVER ({_OW}) AS nxt FROM orders", lambda t: over_orders(t, prev=("lag", "o_orderkey"), nxt=("lead", "o_orderkey")).select("o_orderkey", "prev", "nxt"))
q("w14_cumsum", f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER ({_OW} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cum FROM orders", lambda t: over_orders(t, cum=("running_sum", "v")).select("o_orderkey", c("cum").cast("double").alias("cum")))


def w14_global(t):
    laid, track = lay_track(t.orders.select("o_orderkey", money("o_totalprice").alias("v")), [], ["o_orderkey"])
    return lift_off(scan(laid, track, cum=("running_sum", "v"))).select("o_orderkey", c("cum").cast("double").alias("cum"))


q("w14_global_cumsum", "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (ORDER BY o_orderkey) AS DOUBLE) AS cum FROM orders", w14_global)
q("w15_group_transform", "SELECT s_suppkey, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier", lambda t: spread(t.supplier, ["s_nationkey"], n=F.count(lit(1))).select("s_suppkey", "n"))
q("w16_frequency_rank", "WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT l_partkey, n, row_number() OVER (ORDER BY n DESC, l_partkey) AS rn FROM n",
  lambda t: split_rank(t.lineitem.groupBy("l_partkey").agg(F.count(lit(1)).alias("n")), [], ["n", "l_partkey"], descending=["n"]))
q("w17_quantile_bins", "WITH e AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer) SELECT c_custkey, CASE WHEN c_acctbal > a THEN 1 ELSE 0 END + CASE WHEN c_acctbal > b THEN 1 ELSE 0 END + CASE WHEN c_acctbal > c THEN 1 ELSE 0 END AS bin FROM customer, e",
  lambda t: V.quantile_bins(t.customer, "c_acctbal", 4).select("c_custkey", "bin"))
q("w18_gain_curve", "WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders) SELECT o_orderkey, round(row_number() OVER (ORDER BY v DESC, o_orderkey) / count(*) OVER (), 6) AS cum_customers, round(CAST(sum(v) OVER (ORDER BY v DESC, o_orderkey) AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE), 6) AS gain FROM o",
  lambda t: rounded(V.gain_curve(t.orders.select("o_orderkey", money("o_totalprice").alias("v")), "v", "v", "o_orderkey"), "cum_customers", "gain"))

# ------------------------------------------------------------------ order, limit, set operations
q("o01_order_by", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus, o_orderkey DESC", lambda t: t.orders.select("o_orderkey", "o_orderstatus").orderBy("o_orderstatus", c("o_orderkey").desc()))
q("o02_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", lambda t: t.orders.select("o_orderkey", "o_totalprice").orderBy(c("o_totalprice").desc(), "o_orderkey").limit(10))
q("o03_head", "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 100", lambda t: t.events.select("event_id", "user_id").orderBy("event_id").limit(100))
q("o04_sample", "SELECT o_orderkey FROM orders WHERE CAST('0x' || left(md5('42|' || CAST(o_orderkey AS VARCHAR)), 8) AS BIGINT) / 4294967296.0 < 0.1",
  lambda t: C.sample_rows(t.orders, 0.1, 42, "o_orderkey").select("o_orderkey"))
q("o05_landing_page", "SELECT event_id AS visit_id, CASE WHEN event_id % 2 = 1 AND event_id % 3 <> 1 THEN '/home' ELSE '/' END AS page FROM events", lambda t: N.sessions_in(t).select("visit_id", F.get("hits", lit(0))["page"]["pagePath"].alias("page")))
q("u01_union_all", "SELECT event_id, 'app' AS datasource FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'site' FROM events WHERE event_id % 2 = 1",
  lambda t: t.events.filter("event_id % 2 = 0").select("event_id", lit("app").alias("datasource")).unionByName(t.events.filter("event_id % 2 = 1").select("event_id", lit("site").alias("datasource"))))
q("u02_sentinel_row", f"WITH {_EV} SELECT fvid, sess, medium FROM tt UNION ALL SELECT DISTINCT fvid, -1, 'START' FROM tt", lambda t: _ev(t).select("fvid", "sess", "medium").unionByName(_ev(t).select("fvid", lit(-1).cast("bigint").alias("sess"), lit("START").alias("medium")).distinct()))
q("u03_append", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region", lambda t: t.nation.select(c("n_name").alias("name")).unionByName(t.region.select(c("r_name").alias("name"))))
q("u04_difference", "SELECT DISTINCT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)", lambda t: t.part.select("p_partkey").join(t.lineitem.filter("l_quantity > 40").select("l_partkey"), c("p_partkey") == c("l_partkey"), "left_anti").distinct())
q("u05_union_keys", f"WITH {_HALVES} SELECT k FROM x UNION SELECT k FROM y", lambda t: _halves(t)[0].select("k").unionByName(_halves(t)[1].select("k")).distinct())

# ------------------------------------------------------------------ scalar functions
q("f01_string_basics", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, length(p_name) AS n, left(p_name, 3) AS s3, substr(p_name, 2, 4) AS mid FROM part",
  lambda t: t.part.select("p_partkey", F.upper("p_name").alias("u"), F.lower("p_type").alias("l"), F.length("p_name").alias("n"), F.left("p_name", lit(3)).alias("s3"), F.substring("p_name", 2, 4).alias("mid")))
q("f02_capitalise", "SELECT p_partkey, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS v FROM part", lambda t: t.part.select("p_partkey", X.capitalise("p_type").alias("v")))
q("f03_regexp_replace", "SELECT page_id, regexp_replace(url, '[,;:]', '', 'g') AS v FROM pages", lambda t: t.pages.select("page_id", X.strip_separators("url").alias("v")))
q("f04_regexp_extract", "SELECT event_id, CASE WHEN regexp_matches(v, '^[0-9]+$') THEN v END AS v FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS v FROM events)",
  lambda t: t.events.select("event_id", X.extract_valid(F.when(c("event_id") % 2 == 0, c("user_id").cast("string")).otherwise(c("event_type")), "^[0-9]+$").alias("v")))
q("f05_digests", f"SELECT o_orderkey, md5(concat(coalesce(CAST(a AS VARCHAR), '_'), coalesce(b, '_'))) AS m, upper(sha1(concat('s', CAST(o_orderkey AS VARCHAR)))) AS s FROM {_HOLE}",
  lambda t: _hole(t).select("o_orderkey", X.digest("a", "b").alias("m"), F.upper(F.sha1(F.concat(lit("s"), c("o_orderkey").cast("string")))).alias("s")))
q("f06_plain_letters", f"SELECT conv_id, turn, md5(replace(replace(translate(text, '{X.ACCENTED}', '{X.PLAIN}'), '''', ''), ' ', '_')) AS v FROM conversations",
  lambda t: t.conversations.select("conv_id", "turn", F.md5(F.replace(F.replace(X.plain_letters("text"), lit("'"), lit("")), lit(" "), lit("_"))).alias("v")))
q("f07_nested_split", "SELECT o_orderkey, CAST(o_orderkey * 3 + o_custkey AS BIGINT) AS total, 3 AS n FROM orders",
  lambda t: t.orders.select("o_orderkey", F.concat_ws(";", F.concat_ws(",", c("o_orderkey").cast("string"), (c("o_orderkey") * 2).cast("string")), c("o_custkey").cast("string")).alias("s")).select("o_orderkey", F.flatten(F.transform(F.split("s", ";"), lambda g: F.split(g, ","))).cast("array<bigint>").alias("v")).select("o_orderkey", F.aggregate("v", lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.size("v").alias("n")))
q("f08_replace", "SELECT p_partkey, replace(p_brand, 'Brand#', 'b-') AS v FROM part", lambda t: t.part.select("p_partkey", F.replace("p_brand", lit("Brand#"), lit("b-")).alias("v")))
q("f09_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS s, CAST(CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS VARCHAR) AS d FROM orders",
  lambda t: as_text(t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("s")).withColumn("x", F.when(c("o_orderkey") % 5 != 0, c("s")).otherwise("2020-99")).withColumn("d", F.try_to_date("x", "yyyyMMdd")).drop("x"), "d"))
q("f10_calendar", "SELECT DISTINCT CAST(d AS VARCHAR) AS d, year(d) AS y, week(d) AS w, dayofweek(d) AS dow, date_diff('day', date_trunc('week', date_trunc('month', d)), date_trunc('week', d)) // 7 + 1 AS wom FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)",
  lambda t: as_text(t.orders.select(F.to_date("o_orderdate").alias("d")).distinct().select("d", F.year("d").alias("y"), F.weekofyear("d").alias("w"), (F.dayofweek("d") - 1).alias("dow"), X.week_of_month("d").alias("wom")), "d"))
q("f11_date_math", "SELECT o_orderkey, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(CAST(o_orderdate AS DATE) + 7 AS VARCHAR) AS plus7, CAST(o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS VARCHAR) AS plus_h, 2002 - year(o_orderdate) AS years FROM orders",
  lambda t: as_text(t.orders.select("o_orderkey", F.datediff(F.to_date("o_orderdate"), F.to_date(lit("1995-01-01"))).alias("days"), F.date_add(F.to_date("o_orderdate"), 7).alias("plus7"), (c("o_orderdate") + F.make_dt_interval(hours=(c("o_orderkey") % 24).cast("int"))).alias("plus_h"), X.year_gap("o_orderdate", F.to_date(lit("2002-01-01"))).alias("years")), "plus7", "plus_h"))
q("f12_black_friday", f"SELECT DISTINCT CAST(d AS VARCHAR) AS d, {since_bf_sql('d')} AS days, CAST({bf_sql('year(d)')} AS VARCHAR) AS bf FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)",
  lambda t: as_text(t.orders.select(F.to_date("o_orderdate").alias("d")).distinct().select("d", X.days_since_black_friday("d").alias("days"), X.black_friday(F.year("d")).alias("bf")), "d", "bf"))
q("f13_as_of", "SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS age FROM orders", lambda t: t.orders.select("o_orderkey", F.datediff(F.to_date(lit("2002-01-01")), F.to_date("o_orderdate")).alias("age")))
q("f14_math", "SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS fl, CAST(ceil(c_acctbal) AS BIGINT) AS ce, round(abs(c_acctbal), 4) AS ab, round(ln(abs(c_acctbal) + 1), 6) AS lg, round(exp(-abs(c_acctbal) / 1000), 6) AS ex, round(sqrt(abs(c_acctbal)), 6) AS sq, least(greatest(c_acctbal, 0), 5000) AS cl, round_even(c_custkey / 2.0, 0) AS rh FROM customer",
  lambda t: t.customer.select("c_custkey", F.floor("c_acctbal").alias("fl"), F.ceil("c_acctbal").alias("ce"), F.round(F.abs("c_acctbal"), 4).alias("ab"), F.round(F.ln(F.abs("c_acctbal") + 1), 6).alias("lg"), F.round(F.exp(-F.abs("c_acctbal") / 1000), 6).alias("ex"), F.round(F.sqrt(F.abs("c_acctbal")), 6).alias("sq"), F.least(F.greatest(c("c_acctbal"), lit(0.0)), lit(5000.0)).alias("cl"), F.bround(c("c_custkey") / 2.0, 0).alias("rh")))
q("f15_snap_price", "SELECT p_partkey, round(round_even(p_retailprice / 5, 0) * 5 - 0.01, 2) AS price FROM part", lambda t: t.part.select("p_partkey", F.round(X.snap_price("p_retailprice"), 2).alias("price")))
q("f16_casts", "SELECT o_orderkey, CAST(o_totalprice > 100000 AS INT) AS b, CAST(o_custkey AS VARCHAR) AS s, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders", lambda t: t.orders.select("o_orderkey", (c("o_totalprice") > 100000).cast("int").alias("b"), c("o_custkey").cast("string").alias("s"), F.to_date("o_orderdate").cast("string").alias("d")))
q("f17_coalesce", f"SELECT o_orderkey, coalesce(CAST(a AS VARCHAR), b, 'x') AS v FROM {_HOLE}", lambda t: _hole(t).select("o_orderkey", F.coalesce(c("a").cast("string"), c("b"), lit("x")).alias("v")))
q("f18_array_lookup", "SELECT event_id AS visit_id, CASE WHEN event_id % 11 <> 0 THEN 1 ELSE 0 END AS has_device FROM events", lambda t: N.sessions_in(t).select("visit_id", F.when(X.keyed("customDimensions", 23).isNotNull(), 1).otherwise(0).alias("has_device")))
q("f19_array_exists", "SELECT event_id AS visit_id, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS n2, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS bought FROM events",
  lambda t: N.sessions_in(t).select("visit_id", X.count_where("hits", lambda h: h["eCommerceAction"]["action_type"] == "2").alias("n2"), F.exists("hits", lambda h: h["eCommerceAction"]["action_type"] == "6").cast("int").alias("bought")))
q("f20_flatten", "SELECT event_id AS visit_id, 2 + event_id % 3 + event_id % 4 AS n, 2 + event_id % 3 AS shown FROM events", lambda t: N.sessions_in(t).select("visit_id", F.flatten(F.transform("hits", lambda h: h["product"])).alias("p")).select("visit_id", F.size("p").alias("n"), F.size(F.filter("p", lambda x: x["isImpression"])).alias("shown")))
_words = lambda t: t.documents.select("doc_id", F.array("lang", "source", "lang").alias("a"))
q("f21_array_utils", "SELECT doc_id, 3 AS n, CASE WHEN lang = 'en' THEN 2 ELSE 0 END AS n_en, CASE WHEN lang = 'en' THEN '0,2' ELSE '' END AS at, lang AS last, 2 AS uniq, lang || ',' || source || ',' || lang || ',-,-' AS padded FROM documents",
  lambda t: _words(t).select("doc_id", F.size("a").alias("n"), F.size(F.filter("a", lambda x: x == "en")).alias("n_en"), F.array_join(F.filter(F.transform("a", lambda x, i: F.when(x == "en", i)), lambda i: i.isNotNull()).cast("array<string>"), ",").alias("at"), F.element_at("a", -1).alias("last"), F.size(F.array_distinct("a")).alias("uniq"), F.array_join(F.slice(F.concat("a", F.array_repeat(lit("-"), 5)), 1, 5), ",").alias("padded")))
q("f22_decay", "SELECT o_orderkey, round((o_orderkey * 3600 - o_orderkey * 60) / 86400.0, 6) AS d0, 0.0::DOUBLE AS d1 FROM orders",
  lambda t: t.orders.select("o_orderkey", X.decay_days(F.array(c("o_orderkey") * 60, c("o_orderkey") * 3600)).alias("d")).select("o_orderkey", F.round(c("d")[0], 6).alias("d0"), c("d")[1].alias("d1")))
q("f23_map_replace", "SELECT c_custkey, coalesce(r_name, 'none') AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 3",
  lambda t: t.customer.join(t.nation, c("n_nationkey") == c("c_nationkey"), "left").join(t.region.filter("r_regionkey < 3"), c("r_regionkey") == c("n_regionkey"), "left").select("c_custkey", F.coalesce("r_name", lit("none")).alias("region")))
q("f24_cut", "SELECT p_partkey, CASE WHEN p_size <= 18 THEN '<18' WHEN p_size <= 35 THEN '18-35' ELSE '35+' END AS bin FROM part", lambda t: t.part.select("p_partkey", X.cut("p_size", [float("-inf"), 18, 35, float("inf")], ["<18", "18-35", "35+"]).alias("bin")))
_urls = lambda t: t.part.select("p_partkey", F.concat(F.when(c("p_size") % 3 == 0, "http://").when(c("p_size") % 3 == 1, "/").otherwise(""), lit("img/"), c("p_partkey").cast("string"), lit("/1-z.jpg")).alias("url"))
q("f25_url_normalise", "SELECT p_partkey, 'http://img/' || CAST(p_partkey AS VARCHAR) || '/1-z.jpg' AS url FROM part", lambda t: _urls(t).select("p_partkey", O.image_url("url").alias("url")))
q("f25_url_views", "SELECT p_partkey, 'http://img/' || CAST(p_partkey AS VARCHAR) || '/' || CAST(i AS VARCHAR) || '-z.jpg' AS view_url FROM part, (SELECT unnest([1, 2, 3, 4]) AS i)",
  lambda t: O.image_views(_urls(t).select("p_partkey", O.image_url("url").alias("url")), "url").select("p_partkey", "view_url"))
q("f26_from_json", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events", lambda t: t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k")))
