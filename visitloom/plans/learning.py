"""Queries that encode, fit, score and evaluate."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from visitloom.operators import attribution as A
from visitloom.operators import catalog as C
from visitloom.operators.ml import encode as E
from visitloom.operators.ml import evaluate as V
from visitloom.operators.ml import hazard as Z
from visitloom.operators.ml import hmm as H
from visitloom.operators.ml import models as M
from visitloom.operators.ml import survival as S
from visitloom.plans import inputs as N
from visitloom.plans.journeys import LONG, path_rows
from visitloom.plans.registry import as_int, query, rounded
from visitloom.plans.shelf import CLEAN_SQL, STOP
from visitloom.plans.retail import AS_OF, LABELS, first_orders, labelled
from visitloom.session import store

NUM, CAT = ["age", "gmv", "days_since_last_bf"], ["channel", "device", "gender"]
TRAIN, HELD = "fk_customer % 4 <> 0", "fk_customer % 4 = 0"


def training(t):
    """Labelled customers, written once; every fit and score below reads this table."""
    return store(labelled(t).withColumn("label", F.col("label_180").cast("double")))


LW = f"{LABELS}, lab AS (SELECT *, CAST(CASE WHEN waiting_time < 180 THEN 1 ELSE 0 END AS DOUBLE) AS label FROM lw), tr AS (SELECT * FROM lab WHERE fk_customer % 4 <> 0)"


# ------------------------------------------------------------------ encodings
@query("m01_target_encode", f"""WITH {LW}, pr AS (SELECT avg(label) AS m FROM tr), s AS (SELECT partner AS k, count(*) AS n, avg(label) AS a FROM tr GROUP BY 1)
SELECT fk_customer, partner, round(CASE WHEN n IS NULL OR n = 1 THEN m ELSE m * (1 - 1 / (1 + exp(-(n - 10) / 10.0))) + a * (1 / (1 + exp(-(n - 10) / 10.0))) END, 6) AS partner_te
FROM lab LEFT JOIN s ON k = partner, pr""")
def m01(t):
    df = training(t)
    return rounded(E.target_encode(df.filter(TRAIN), df, ["partner"], "label").select("fk_customer", "partner", "partner_te"), "partner_te")


@query("m02_pseudo_encode", f"""WITH {LW}, pr AS (SELECT avg(label) AS m FROM tr), s AS (SELECT state AS k, count(*) AS n, sum(label) AS p FROM tr GROUP BY 1)
SELECT fk_customer, round((p + 5 * m) / (n + 5), 6) AS avg_rate_state, round(ln((1 + n) / 5.0), 6) AS confidence_state FROM lab LEFT JOIN s ON k = state, pr""")
def m02(t):
    df = training(t)
    out = E.pseudo_encode(df.filter(TRAIN), df, ["state"], "label", 5)
    return rounded(out.select("fk_customer", "avg_rate_state", "confidence_state"), "avg_rate_state", "confidence_state")


@query("m03_one_hot", f"""WITH {LW}, lv AS (SELECT channel, row_number() OVER (ORDER BY count(*) DESC, channel) - 1 AS ix FROM tr GROUP BY 1)
SELECT fk_customer, ix AS hot FROM lab JOIN lv USING (channel)""")
def m03(t):
    from pyspark.ml import Pipeline
    df = training(t)
    model = Pipeline(stages=M.feature_stages(categorical=["channel"])).fit(df.filter(TRAIN))
    vec = vector_to_array("features")
    return model.transform(df).select("fk_customer", (F.array_position(vec, F.lit(1.0)) - 1).alias("hot"))


@query("m04_quantile_transform", f"""WITH {LW}, r AS (SELECT fk_customer, gmv, rank() OVER (ORDER BY gmv) AS lo, count(*) OVER (PARTITION BY gmv) AS same, count(*) OVER () AS n FROM lab)
SELECT fk_customer, round((lo - 1 + (same - 1) / 2) / (n - 1), 6) AS gmv_q FROM r""")
def m04(t):
    df = training(t)
    return rounded(E.quantile_transform(df, df, "gmv").select("fk_customer", "gmv_q"), "gmv_q")


@query("m05_standardise", f"WITH {LW}, s AS (SELECT avg(gmv) AS m, stddev_pop(gmv) AS d FROM tr) SELECT fk_customer, round((gmv - m) / d, 6) AS gmv_z FROM lab, s")
def m05(t):
    df = training(t)
    return rounded(E.standardise(df.filter(TRAIN), df, ["gmv"]).select("fk_customer", "gmv_z"), "gmv_z")


@query("m10_class_weights", f"WITH {LW} SELECT label, round(count(*) OVER () / 2 / count(*) OVER (PARTITION BY label), 6) AS weight, fk_customer FROM lab")
def m10(t):
    return rounded(E.class_weights(training(t), "label").select("fk_customer", "label", "weight"), "weight")


@query("m10_downsample", f"""WITH {LW}, r AS (SELECT fk_customer, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(fk_customer AS VARCHAR)), fk_customer) AS rn FROM lab)
SELECT fk_customer, label FROM r WHERE rn <= (SELECT min(n) FROM (SELECT count(*) AS n FROM lab GROUP BY label))""")
def m10_down(t):
    return E.downsample(training(t).select("fk_customer", "label"), "label", "fk_customer")


# ------------------------------------------------------------------ fits (checked by row count)
def _fit_and_score(t, kind, **params):
    df = training(t)
    model = M.fit(kind, df.filter(TRAIN), M.feature_stages(NUM, CAT), **params)
    return V.confusion(model.transform(df.filter(HELD)))


@query("m06_gbt_classifier")
def m06(t):
    return _fit_and_score(t, "gbt")


NO_REPURCHASE = 7                 # the class after the last eight-week period of a year


@query("m07_multiclass")
def m07(t):
    from visitloom.operators.customers import repurchase_bins
    df = repurchase_bins(training(t)).withColumn("label", F.coalesce("rep_class", F.lit(NO_REPURCHASE)).cast("double"))
    model = M.fit("gbt_multiclass", df.filter(TRAIN), M.feature_stages(NUM, CAT))
    return V.class_report(model.transform(df.filter(HELD)))


def _rates_by_weight(models, held):
    parts = [V.binary_rates(m.transform(held)).withColumn("weight", F.lit(w)) for w, m in models.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("m08_logistic_weights")
def m08(t):
    df = training(t)
    models = M.weight_sweep("logistic", df.filter(TRAIN), M.feature_stages(NUM, CAT, scale=True))
    return _rates_by_weight(models, df.filter(HELD))


@query("m09_random_forest")
def m09(t):
    df = E.class_weights(training(t), "label")
    model = M.fit("forest", df.filter(TRAIN), M.feature_stages(NUM, CAT), weight="weight")
    return V.class_report(model.transform(df.filter(HELD)))


@query("m09_forest_weights")
def m09_weights(t):
    df = training(t)
    return _rates_by_weight(M.weight_sweep("forest", df.filter(TRAIN), M.feature_stages(NUM, CAT), weights=range(1, 4)), df.filter(HELD))


@query("m11_kmeans")
def m11(t):
    from pyspark.ml.functions import array_to_vector
    df = t.embeddings.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return M.cluster_vs_label(M.classifier("kmeans", k=2).fit(df).transform(df), "label")


def _tokens(t):
    return C.clean_text(t.documents, "text", STOP).select("doc_id", F.split("text", " ").alias("words"))


_CLEAN = CLEAN_SQL.replace("{c}", "text").replace("{stop}", "")


@query("m12_tfidf_mean_weight", f"""WITH d AS (SELECT doc_id, string_split({_CLEAN}, ' ') AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS term FROM d),
p AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w GROUP BY 1 ORDER BY tf DESC, term LIMIT 500)
SELECT term, round(tf / (SELECT count(*) FROM d) * ln(((SELECT count(*) FROM d) + 1) / (df + 1)), 6) AS weight FROM p""")
def m12(t):
    return rounded(M.mean_term_weight(_tokens(t), "words", 500), "weight")


TERMS = 500
VECTORS = f"""d AS (SELECT doc_id, lang, string_split({_CLEAN}, ' ') AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS term FROM d),
p AS (SELECT term, count(DISTINCT doc_id) AS df FROM w GROUP BY 1 ORDER BY count(*) DESC, term LIMIT {TERMS}),
c AS (SELECT doc_id, term, count(*) * (ln((1.0::DOUBLE + (SELECT count(*) FROM d)) / (1 + any_value(df))) + 1) AS raw FROM w JOIN p USING (term) GROUP BY 1, 2),
tv AS (SELECT doc_id, term, raw / sqrt(sum(raw ** 2) OVER (PARTITION BY doc_id)) AS weight FROM c)"""


def _vectors(t):
    tokens = store(_tokens(t))
    return store(M.document_vectors(tokens, "doc_id", "words", store(M.vocabulary(tokens, "doc_id", "words", TERMS)), tokens.count())), tokens


@query("m12_document_vectors", f"WITH {VECTORS} SELECT doc_id, term, round(weight, 6) AS weight FROM tv")
def m12_vectors(t):
    return rounded(_vectors(t)[0].select("doc_id", "term", "weight"), "weight")


@query("m12_mean_document_weight", f"WITH {VECTORS} SELECT term, round(sum(weight) / (SELECT count(*) FROM d), 7) AS weight FROM tv GROUP BY 1")
def m12_mean_vectors(t):
    """Mean of a term's weight over all documents, those without it included."""
    vectors, tokens = _vectors(t)
    return rounded(vectors.groupBy("term").agg((F.sum("weight") / tokens.count()).alias("weight")), "weight", digits=7)


@query("m12_vector_classifier")
def m12_classifier(t):
    """Documents sorted by language from their vectors: learned on three quarters, counted on the rest."""
    vectors, _ = _vectors(t)
    rows = store(M.as_features(vectors, "doc_id", TERMS).join(t.documents.filter("lang IS NOT NULL").select("doc_id", "lang"), "doc_id"))
    levels = sorted(r.lang for r in rows.select("lang").distinct().collect())
    rows = rows.withColumn("label", F.array_position(F.array(*[F.lit(v) for v in levels]), F.col("lang")).cast("double") - 1)
    model = M.classifier("logistic", maxIter=50, regParam=0.001).fit(rows.filter("doc_id % 4 <> 0"))
    named = F.element_at(F.array(*[F.lit(v) for v in levels]), (F.col("prediction") + 1).cast("int"))
    return V.confusion(model.transform(rows.filter("doc_id % 4 = 0")).withColumn("prediction", named).withColumn("label", F.col("lang")), "label", "prediction")


@query("m12_bag_of_touches", f"""WITH {LONG}, p AS (SELECT gid || '/' || CAST(conv_group AS VARCHAR) AS path, pos, trin FROM long),
v AS (SELECT trin, row_number() OVER (ORDER BY count(*) DESC, trin) AS rn FROM p GROUP BY 1),
k AS (SELECT path, pos, rn FROM p JOIN v USING (trin) WHERE rn <= 20), pids AS (SELECT DISTINCT path FROM p)
SELECT pids.path, coalesce(string_agg(CAST(rn AS VARCHAR), ',' ORDER BY pos), '') AS tokens FROM pids LEFT JOIN k ON k.path = pids.path GROUP BY pids.path""")
def m12_bag(t):
    arrays = path_rows(t).groupBy(F.concat_ws("/", "gid", F.col("conv_group").cast("string")).alias("path")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "trin"))).getField("trin").alias("trins"))
    out = E.frequent_tokens(arrays, "trins", 20, None, "path")
    shown = F.array_join(F.filter("token_ids", lambda x: x > 0).cast("array<string>"), ",")
    return out.select("path", shown.alias("tokens"))


# ------------------------------------------------------------------ evaluation
SCORED = """sc AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS score,
  o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_custkey FROM orders)"""


def scored(t):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
                           ((k * 7919) % 1000 / 1000.0).alias("score"), F.col("o_orderstatus").alias("status"),
                           F.col("o_totalprice").cast("decimal(18,2)").alias("price"), "o_custkey")


@query("m13_confusion", "SELECT toxic AS label, quality AS prediction, count(*) AS n FROM labels GROUP BY 1, 2")
def m13(t):
    return V.confusion(t.labels, "toxic", "quality")


@query("m13_class_report", """WITH c AS (SELECT toxic AS y, quality AS p, count(*) AS n FROM labels GROUP BY 1, 2), k AS (SELECT DISTINCT y AS class FROM c UNION SELECT DISTINCT p FROM c),
s AS (SELECT class, coalesce((SELECT sum(n) FROM c WHERE y = class), 0) AS support, coalesce((SELECT sum(n) FROM c WHERE p = class), 0) AS predicted,
  coalesce((SELECT sum(n) FROM c WHERE y = class AND p = class), 0) AS tp FROM k)
SELECT class, round(coalesce(tp / nullif(predicted, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(predicted + support, 0), 0), 6) AS f1, CAST(support AS BIGINT) AS support FROM s""")
def m13_report(t):
    return rounded(V.class_report(t.labels, "toxic", "quality"), "precision", "recall", "f1")


@query("m13_binary_rates", """WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic = 0 AND quality = 0) AS tn,
  count(*) FILTER (toxic = 0 AND quality = 1) AS fp, count(*) FILTER (toxic = 1 AND quality = 0) AS fn FROM labels)
SELECT *, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS tpr, round(tn / (tn + fp), 6) AS tnr FROM c""")
def m13_rates(t):
    return rounded(V.binary_rates(t.labels, "toxic", "quality"), "accuracy", "precision", "tpr", "tnr")


def _auc_sql(src: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {by + ',' if by else ''} CAST(sum(label) AS BIGINT) AS positives, CAST(sum(1 - label) AS BIGINT) AS negatives,
  round((sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 6) AS auc
FROM (SELECT *, rank() OVER ({part} ORDER BY score) + (count(*) OVER (PARTITION BY {by + ',' if by else ''} score) - 1) / 2 AS r FROM {src}) {'GROUP BY ' + by if by else ''}"""


@query("m14_auc", f"WITH {SCORED} {_auc_sql('sc')}")
def m14(t):
    return rounded(V.auc(scored(t)), "auc")


@query("m14_auc_by_group", f"WITH {SCORED}, g AS (SELECT *, o_custkey % 5 AS grp FROM sc) {_auc_sql('g', 'grp')}")
def m14_by(t):
    return rounded(V.auc(scored(t).withColumn("grp", F.col("o_custkey") % 5), by=["grp"]), "auc")


MULTI = {"F": "s_f", "O": "s_o", "P": "s_p"}
MULTI_SQL = f"""{SCORED}, ml AS (SELECT 'F' AS class, CASE WHEN status = 'F' THEN 1 ELSE 0 END AS label, score FROM sc UNION ALL
  SELECT 'O', CASE WHEN status = 'O' THEN 1 ELSE 0 END, 1 - score FROM sc UNION ALL SELECT 'P', CASE WHEN status = 'P' THEN 1 ELSE 0 END, (o_custkey % 100) / 100.0::DOUBLE FROM sc)"""


@query("m14_multiclass_auc", f"""WITH {MULTI_SQL}, e AS ({_auc_sql('ml', 'class')}) SELECT class, auc FROM e
UNION ALL SELECT 'macro', round(avg(auc), 5) FROM e UNION ALL SELECT 'micro', auc FROM ({_auc_sql('ml')})""")
def m14_multi(t):
    df = scored(t).withColumns({"s_f": F.col("score"), "s_o": 1 - F.col("score"), "s_p": F.col("o_custkey") % 100 / 100.0})
    out = V.multiclass_auc(df, "status", MULTI)
    return out.withColumn("auc", F.when(F.col("class") == "macro", F.round("auc", 5)).otherwise(F.round("auc", 6)))


@query("m14_roc_curve", f"""WITH {SCORED}, c AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM sc GROUP BY 1)
SELECT score AS threshold, round(sum(n) OVER (ORDER BY score DESC) / sum(n) OVER (), 6) AS fpr, round(sum(p) OVER (ORDER BY score DESC) / sum(p) OVER (), 6) AS tpr FROM c""")
def m14_roc(t):
    return rounded(V.roc_curve(scored(t)), "fpr", "tpr")


SWEEP = f"""{SCORED}, b AS (SELECT min(score) AS lo, max(score) * 0.999::DOUBLE AS hi FROM sc), th AS (SELECT k, lo + k * ((hi - lo) / 99) AS threshold FROM b, (SELECT unnest(range(100)) AS k)),
m AS (SELECT k, threshold, sum(CASE WHEN score >= threshold THEN label ELSE 0 END) AS tp, sum(CASE WHEN score >= threshold THEN 1 ELSE 0 END) AS ch, sum(label) AS ap FROM th, sc GROUP BY 1, 2),
sw AS (SELECT k, round(threshold, 6) AS threshold, round(coalesce(tp / nullif(ch, 0), 0), 6) AS precision, round(tp / ap, 6) AS recall, round(coalesce(2 * tp / nullif(ch + ap, 0), 0), 6) AS f1 FROM m)"""


@query("m15_threshold_sweep", f"WITH {SWEEP} SELECT * FROM sw")
def m15(t):
    return rounded(V.threshold_sweep(scored(t)), "threshold", "precision", "recall", "f1")


@query("m15_best_f1", f"WITH {SWEEP} SELECT * FROM sw ORDER BY f1 DESC, threshold LIMIT 1")
def m15_best(t):
    return V.best_f1(rounded(V.threshold_sweep(scored(t)), "threshold", "precision", "recall", "f1"))


@query("m15_calibration_bins", f"WITH {SCORED} SELECT CAST(ceil(round(score * 10, 9)) AS INT) AS bin, count(*) AS n, round(avg(label), 6) AS fraction FROM sc WHERE score > 0 GROUP BY 1")
def m15_bins(t):
    return rounded(V.calibration_bins(scored(t)), "fraction")


@query("m15_hazard_scores", f"WITH {SCORED} SELECT o_orderkey, round(score / nullif(score + 0.5 + 0.25, 0), 6) AS a_hazard, round(0.5 / 0.75, 6) AS b_hazard, 1.0::DOUBLE AS c_hazard FROM sc")
def m15_hazard(t):
    df = scored(t).select("o_orderkey", F.col("score").alias("a"), F.lit(0.5).alias("b"), F.lit(0.25).alias("c"))
    return rounded(V.hazard_scores(df, ["a", "b", "c"]).drop("a", "b", "c"), "a_hazard", "b_hazard", "c_hazard")


GAIN = lambda c: f"SELECT 2 * avg(g) - 1 AS raw FROM (SELECT sum(price) OVER (ORDER BY {c} DESC, o_orderkey ROWS UNBOUNDED PRECEDING)::DOUBLE / (SELECT sum(price) FROM sc)::DOUBLE AS g FROM sc)"


@query("m19_gain_gini", f"""WITH {SCORED}, r AS (SELECT 'lorenz' AS curve, raw FROM ({GAIN('price')}) UNION ALL SELECT 'baseline', raw FROM ({GAIN('o_custkey')}) UNION ALL SELECT 'model', raw FROM ({GAIN('score')}))
SELECT curve, round(raw, 6) AS raw, round(raw / max(CASE WHEN curve = 'lorenz' THEN raw END) OVER (), 6) AS normalized FROM r""")
def m19(t):
    return rounded(V.gain_gini(scored(t), "price", "score", "o_custkey", "o_orderkey"), "raw", "normalized")


@query("m19_decile_stats", f"""WITH {SCORED}, q AS (SELECT {', '.join(f'quantile_cont(price::DOUBLE, {i / 10}) AS e{i}' for i in range(1, 10))} FROM sc),
d AS (SELECT {' + '.join(f'CASE WHEN price::DOUBLE > e{i} THEN 1 ELSE 0 END' for i in range(1, 10))} AS decile, price::DOUBLE AS p, (price + o_custkey)::DOUBLE AS y FROM sc, q)
SELECT decile, round(avg(y), 4) AS label_mean, round(avg(p), 4) AS pred_mean, round(sqrt(avg((y - p) ** 2)) / avg(y), 6) AS normalized_rmse,
  round(avg(abs(y - p)) / avg(y), 6) AS normalized_mae, round(abs(avg(p) - avg(y)) / avg(y), 6) AS decile_mape FROM d GROUP BY 1""")
def m19_decile(t):
    df = scored(t).withColumn("y", F.col("price") + F.col("o_custkey"))
    out = rounded(V.decile_stats(df, "y", "price"), "normalized_rmse", "normalized_mae", "decile_mape")
    return rounded(out, "label_mean", "pred_mean", digits=4)


@query("m21_mutual_info", f"""WITH {SCORED}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM sc), c AS (SELECT least(floor((score - lo) / (hi - lo) * 20), 19) AS b, label AS y, count(*) AS n FROM sc, e GROUP BY 1, 2),
m AS (SELECT greatest(sum(n / tot * ln(n * tot / (nb * ny))), 0) AS mi FROM (SELECT n, sum(n) OVER () AS tot, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY y) AS ny FROM c))
SELECT round(mi, 6) AS mi, round(sqrt(1 - exp(-2 * mi)), 6) AS total_correlation FROM m""")
def m21(t):
    return rounded(V.mutual_info(scored(t), "score", "label"), "mi", "total_correlation")


# ------------------------------------------------------------------ scoring, search, calibration
_PSI = lambda m: (f"(ln({m} + 6.0) - 1 / (2 * ({m} + 6.0)) - 1 / (12 * ({m} + 6.0) ** 2) + 1 / (120 * ({m} + 6.0) ** 4) - 1 / (252 * ({m} + 6.0) ** 6)"
                  f" - 1.0 / {m}" + "".join(f" - 1.0 / ({m} + {j})" for j in range(1, 6)) + ")")


def _neighbours_sql(k: int) -> str:
    """Brute force: every row against all rows of its feature."""
    return f"""WITH {SCORED}, lo AS (SELECT o_orderkey AS id, label AS y, 'score' AS feature, round(score * 1000) AS x FROM sc UNION ALL SELECT o_orderkey, label, 'cents', CAST(price * 100 AS BIGINT)::DOUBLE FROM sc),
sz AS (SELECT *, count(*) OVER (PARTITION BY feature, y) AS size FROM lo),
la AS (SELECT *, {', '.join(f'lag(x, {j}) OVER o AS b{j}, lead(x, {j}) OVER o AS a{j}' for j in range(1, k + 1))} FROM sz WHERE size > 1 WINDOW o AS (PARTITION BY feature, y ORDER BY x, id)),
ra AS (SELECT feature, id, x, size, least({k}, size - 1) AS k, list_sort(list_filter([{', '.join(f'abs(b{j} - x), abs(a{j} - x)' for j in range(1, k + 1))}], lambda d: d IS NOT NULL))[least({k}, size - 1)] AS r FROM la),
vc AS (SELECT feature, x, count(*) AS n FROM ra GROUP BY 1, 2),
rr AS (SELECT DISTINCT feature, x, r FROM ra),
co AS (SELECT a.feature, a.x, a.r, CAST(sum(n) AS DOUBLE) AS m FROM rr a JOIN vc b ON a.feature = b.feature AND b.x BETWEEN a.x - a.r AND a.x + a.r AND (abs(b.x - a.x) < a.r OR a.r = 0) GROUP BY 1, 2, 3),
mi AS (SELECT ra.feature, greatest(0, {_PSI('CAST(count(*) AS DOUBLE)')} + avg({_PSI('CAST(k AS DOUBLE)')} - {_PSI('CAST(size AS DOUBLE)')} - {_PSI('m')})) AS mi FROM ra JOIN co ON ra.feature = co.feature AND ra.x = co.x AND ra.r = co.r GROUP BY 1)
SELECT feature, round(mi, 6) AS mi, round(sqrt(1 - exp(-2 * mi)), 6) AS total_correlation FROM mi"""


@query("m21_nearest_neighbours", _neighbours_sql(3))
def m21_neighbours(t):
    df = scored(t).select("o_orderkey", "label", F.round(F.col("score") * 1000).alias("score"), F.round(F.col("price") * 100).alias("cents"))
    return rounded(V.nearest_mutual_info(df, ["score", "cents"], "label", "o_orderkey"), "mi", "total_correlation")


@query("m16_batch_score")
def m16(t):
    df = training(t)
    models = {}
    for h in (15, 30, 90, 180):
        rows = df.filter(TRAIN).withColumn("label", F.col(f"label_{h}").cast("double"))
        models[str(h)] = M.fit("logistic", rows, M.feature_stages(NUM, CAT, scale=True))
    return M.batch_score(models, df, "fk_customer")


@query("m17_search")
def m17(t):
    space = {"maxDepth": ("int", 2, 4), "maxIter": ("int", 5, 10), "stepSize": ("log", 0.05, 0.3), "subsamplingRate": ("real", 0.6, 1.0),
             "featureSubsetStrategy": ("choice", ["sqrt", "all"])}
    model = M.search(training(t).filter(TRAIN), M.feature_stages(NUM, CAT), "gbt", space, draws=4, folds=2)
    return M.search_table(t.spark, model)


@query("m18_calibrate")
def m18(t):
    """Five folds of the training rows fit the map; it is applied to rows that neither model nor map has seen."""
    df, stages = training(t), M.feature_stages(NUM, CAT, scale=True)
    folds = store(M.out_of_fold(df.filter(TRAIN), stages, "logistic", "fk_customer"))
    held = M.fit("logistic", df.filter(TRAIN), stages).transform(df.filter(HELD)).select("fk_customer", "label", M.positive_score().alias("score"))
    return M.calibrate(folds).transform(held)


@query("m18_folds", f"WITH {LW} SELECT label, count(*) AS n FROM tr GROUP BY 1")
def m18_folds(t):
    """Every training row is scored out of fold once."""
    folds = M.out_of_fold(training(t).filter(TRAIN), M.feature_stages(NUM, CAT, scale=True), "logistic", "fk_customer")
    return folds.groupBy("label").agg(F.count("score").alias("n"))


@query("m20_importance")
def m20(t):
    df = training(t)
    model = M.fit("forest", df.filter(TRAIN), M.feature_stages(NUM, CAT))
    return M.importance(model, model.transform(df.filter(TRAIN)))


# ------------------------------------------------------------------ survival
def durations(t):
    fo = first_orders(t, True)
    date = lambda c: F.try_to_date(c, "yyyyMMdd")
    return S.weekly_durations(fo.select("fk_customer", "gender", "age", "gmv", date("first_sale_date").alias("f"), date("second_sale_date").alias("s")), "f", "s", AS_OF)


DUR = f"{LABELS}, du AS (SELECT fk_customer, gender, age, gmv, CASE WHEN s IS NULL THEN 0 ELSE 1 END AS event, CAST(ceil(date_diff('day', f, coalesce(s, DATE '{AS_OF}')) / 7) AS INT) AS week FROM lw)"
KM = f"""{DUR}, w AS (SELECT gender, week, count(*) AS n, sum(event) AS events FROM du GROUP BY 1, 2),
km AS (SELECT gender, week, sum(n) OVER (PARTITION BY gender ORDER BY week DESC) AS at_risk, events FROM w),
kt AS (SELECT gender, week, at_risk, events, product(1 - events / at_risk) OVER (PARTITION BY gender ORDER BY week ROWS UNBOUNDED PRECEDING) AS survival FROM km)"""


@query("m22_survival_table", f"WITH {KM} SELECT gender, week, CAST(at_risk AS BIGINT) AS at_risk, CAST(events AS BIGINT) AS events, round(survival, 6) AS survival FROM kt")
def m22(t):
    return rounded(S.survival_table(durations(t), by=["gender"]), "survival")


@query("m22_survival_at", f"WITH {KM} SELECT gender, " + ", ".join(f"round(coalesce(arg_max(survival, week) FILTER (week <= {w}), 1), 6) AS w{w}" for w in S.REPORT_WEEKS) + " FROM kt GROUP BY 1")
def m22_at(t):
    return rounded(S.survival_at(S.survival_table(durations(t), by=["gender"]), by=["gender"]), *[f"w{w}" for w in S.REPORT_WEEKS])


@query("m22_concordance", f"""WITH {DUR}, p AS (SELECT a.gmv AS ra, b.gmv AS rb FROM du a JOIN du b ON a.event = 1 AND a.week < b.week)
SELECT count(*) AS pairs, round(sum(CASE WHEN ra > rb THEN 1 WHEN ra = rb THEN 0.5 ELSE 0 END) / count(*), 6) AS c_index FROM p""")
def m22_c(t):
    return rounded(S.concordance(durations(t).withColumn("risk", F.col("gmv")), "risk"), "c_index")


SURVIVAL_FEATURES = ["age", "gmv"]
NEWTON_STEPS = 9


def _newton_sql() -> str:
    """Newton steps on the partial likelihood of age and gmv, one group of CTEs per step; ends in ``beta`` (x, y)."""
    out = f"""{DUR}, ok AS (SELECT * FROM du WHERE age IS NOT NULL AND gmv IS NOT NULL AND week IS NOT NULL),
mid AS (SELECT avg(age::DOUBLE) AS ma, avg(gmv::DOUBLE) AS mg FROM ok),
ce AS MATERIALIZED (SELECT fk_customer, week, event, age::DOUBLE - ma AS a, gmv::DOUBLE - mg AS g FROM ok, mid),
b0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS x, 0.0::DOUBLE AS y)"""
    sums = ("e", "a * e", "g * e", "a * a * e", "a * g * e", "g * g * e")
    for k in range(1, NEWTON_STEPS + 1):
        out += f""",
w{k} AS MATERIALIZED (SELECT week, sum(event) AS d, sum(event * a) AS xa, sum(event * g) AS xg, {', '.join(f'sum({c}) AS s{i}' for i, c in enumerate(sums))}
  FROM (SELECT *, exp(a * x + g * y) AS e FROM ce, b{k - 1}) GROUP BY week),
r{k} AS MATERIALIZED (SELECT week, d, xa, xg, {', '.join(f'sum(s{i}) OVER (ORDER BY week DESC) AS r{i}' for i in range(6))} FROM w{k}),
q{k} AS MATERIALIZED (SELECT sum(xa - d * r1 / r0) AS ga, sum(xg - d * r2 / r0) AS gg, sum(d * (r3 / r0 - (r1 / r0) ** 2)) AS haa,
  sum(d * (r4 / r0 - r1 * r2 / r0 ** 2)) AS hag, sum(d * (r5 / r0 - (r2 / r0) ** 2)) AS hgg FROM r{k}),
b{k} AS MATERIALIZED (SELECT x + (ga * hgg - gg * hag) / (haa * hgg - hag ** 2) AS x, y + (gg * haa - ga * hag) / (haa * hgg - hag ** 2) AS y FROM b{k - 1}, q{k})"""
    return out + f""",
base AS MATERIALIZED (SELECT week, d, r0, d / r0 AS hazard, sum(d / r0) OVER (ORDER BY week) AS cumulative
  FROM (SELECT week, d, sum(s0) OVER (ORDER BY week DESC) AS r0 FROM (SELECT week, sum(event) AS d, sum(exp(a * x + g * y)) AS s0 FROM ce, b{NEWTON_STEPS} GROUP BY week))),
sv AS MATERIALIZED (SELECT ce.*, {', '.join(f'exp(-coalesce((SELECT max(cumulative) FILTER (week <= {w}) FROM base), 0) * exp(a * x + g * y)) AS w{w}' for w in S.REPORT_WEEKS)} FROM ce, b{NEWTON_STEPS})"""


HAZARD = _newton_sql()


def _hazard_model(df):
    return Z.fit_hazard(df, SURVIVAL_FEATURES)


@query("m22_hazard_coefficients", f"WITH {HAZARD} SELECT 'age' AS feature, round(x, 8) AS coefficient FROM b{NEWTON_STEPS} UNION ALL SELECT 'gmv', round(y, 8) FROM b{NEWTON_STEPS}")
def m22_hazard(t):
    """Proportional-hazards coefficients by Newton steps on the partial likelihood."""
    model = _hazard_model(durations(t))
    out = t.spark.createDataFrame(list(zip(model.features, model.coefficients)), "feature string, coefficient double")
    return rounded(out, "coefficient", digits=8)


@query("m22_baseline_hazard", f"WITH {HAZARD} SELECT CAST(week AS BIGINT) AS week, CAST(d AS BIGINT) AS events, round(r0, 4) AS at_risk, round(hazard, 8) AS hazard, round(cumulative, 7) AS cumulative FROM base")
def m22_baseline(t):
    df = store(durations(t))
    out = Z.baseline_hazard(df, _hazard_model(df))
    return rounded(rounded(rounded(out, "at_risk", digits=4), "hazard", digits=8), "cumulative", digits=7)


@query("m22_customer_survival", f"WITH {HAZARD} SELECT fk_customer, {', '.join(f'round(w{w}, 6) AS w{w}' for w in S.REPORT_WEEKS)} FROM sv")
def m22_customers(t):
    df = store(durations(t))
    model = _hazard_model(df)
    return rounded(Z.survival_of(model, Z.baseline_hazard(df, model), df, "fk_customer"), *[f"w{w}" for w in S.REPORT_WEEKS])


@query("m22_decile_validation", f"""WITH {HAZARD}, se AS (SELECT round(1 - w9, 6) AS p, CASE WHEN event = 1 AND week <= 9 THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM sv WHERE event = 1 OR week >= 9),
qs AS (SELECT {', '.join(f'quantile_cont(p, {i / 10}) AS e{i}' for i in range(1, 10))} FROM se),
de AS (SELECT {' + '.join(f'CASE WHEN p > e{i} THEN 1 ELSE 0 END' for i in range(1, 10))} AS decile, p, y FROM se, qs)
SELECT decile, round(avg(y), 6) AS label_mean, round(avg(p), 6) AS pred_mean, round(sqrt(avg((y - p) ** 2)) / nullif(avg(y), 0), 5) AS normalized_rmse,
  round(avg(abs(y - p)) / nullif(avg(y), 0), 5) AS normalized_mae, round(abs(avg(p) - avg(y)) / nullif(avg(y), 0), 5) AS decile_mape FROM de GROUP BY 1""")
def m22_deciles(t):
    """Predicted against observed repurchase by week 9, per decile of the prediction."""
    df = store(durations(t))
    model = _hazard_model(df)
    scored = Z.survival_of(model, Z.baseline_hazard(df, model), df, "fk_customer", keep=["week", "event"])
    seen = scored.filter("event = 1 OR week >= 9").select("fk_customer", F.round(1 - F.col("w9"), 6).alias("pred"), ((F.col("event") == 1) & (F.col("week") <= 9)).cast("int").alias("bought"))
    out = rounded(V.decile_stats(store(seen), "bought", "pred"), "label_mean", "pred_mean")
    return rounded(out, "normalized_rmse", "normalized_mae", "decile_mape", digits=5)


@query("m22_accelerated_failure")
def m22_aft(t):
    """The Weibull accelerated-failure model, as proportional-hazards coefficients."""
    model = S.fit_survival(durations(t), SURVIVAL_FEATURES)
    return t.spark.createDataFrame(S.hazard_coefficients(model, SURVIVAL_FEATURES), "feature string, coefficient double")


SELECTION_FOLDS = 5


def _selection_rows(t):
    fo = first_orders(t, True)
    date = lambda c: F.try_to_date(c, "yyyyMMdd")
    df = S.weekly_durations(fo.select("fk_customer", "channel", "device", "gender", "age", "gmv", date("first_sale_date").alias("f"), date("second_sale_date").alias("s")), "f", "s", AS_OF)
    df, made = Z.dummies(store(df), ["channel", "device", "gender"])
    features = SURVIVAL_FEATURES + made
    return Z.usable(df, features, fold=F.col("fk_customer") % SELECTION_FOLDS), features


@query("m22_selection_grid")
def m22_grid(t):
    """Concordance on the held fold of the k features with the best univariate concordance, for every k and fold."""
    rows, features = _selection_rows(t)
    return rounded(Z.selection_grid(rows, features, range(1, len(features) + 1), SELECTION_FOLDS), "c_index")


@query("m22_fold_scores")
def m22_fold_scores(t):
    """Univariate hazard fits on all folds but one, with the concordance that ranks the features."""
    rows, features = _selection_rows(t)
    return rounded(Z.univariate_scores(rows, features, range(SELECTION_FOLDS)), "coefficient", "c_index")


@query("m22_univariate_scores", f"""WITH {DUR}, {', '.join(f"c_{x} AS (SELECT count(*) AS pairs, sum(CASE WHEN a.{x} > b.{x} THEN 1 WHEN a.{x} = b.{x} THEN 0.5 ELSE 0 END) AS good FROM du a JOIN du b ON a.event = 1 AND a.week < b.week AND a.{x} IS NOT NULL AND b.{x} IS NOT NULL)" for x in ("age", "gmv"))}
""" + " UNION ALL ".join(f"SELECT '{x}' AS feature, pairs, round(good / pairs, 6) AS c_index FROM c_{x}" for x in ("age", "gmv")))
def m22_univariate(t):
    df = store(durations(t))
    parts = [S.concordance(df, x).withColumn("feature", F.lit(x)) for x in SURVIVAL_FEATURES]
    return rounded(parts[0].unionByName(parts[1]), "c_index")


# ------------------------------------------------------------------ model-based attribution, hidden states
def _path_arrays(t):
    return store(path_rows(t).groupBy("gid", "conv_group", F.col("cv_marker").cast("double").alias("label")).agg(
        F.min("datasource").alias("os"), F.array_sort(F.collect_list(F.struct("pos", "trin"))).getField("trin").alias("trins")))


VOCABULARY = 1 << 18              # the counting stage's own maximum; every medium here is far below it


def _touch_model(paths):
    return M.fit("logistic", paths, M.feature_stages(tokens="trins", vocab=VOCABULARY))


@query("d31_model_removal_effect")
def d31(t):
    paths = _path_arrays(t)
    effect = A.model_removal_effect(paths, _touch_model(paths), tokens="trins", score=M.positive_score())
    return rounded(effect, "rm_eff", "scaled_rm_eff")


@query("d32_removal_by_group")
def d32(t):
    paths = _path_arrays(t)
    return rounded(A.model_removal_effect(paths, _touch_model(paths), by=["os"], tokens="trins", score=M.positive_score()), "rm_eff", "scaled_rm_eff")


def _views(t):
    return store(path_rows(t).select("gid", "conv_group", "pos", "medium", "n_views", "is_to_cart", F.col("value").cast("double").alias("value")))


PATH_KEYS = ["gid", "conv_group"]
# The engagement funnel's weights. Paths move onward only and leave from the last state.
FUNNEL = H.topology([0.5, 0.3, 0.2, 0.0], [[1, 1, 1, 1], [0, 1, 1, 1], [0, 0, 1, 1], [0, 0, 0, 1]], [0, 0, 0, 4], [0.25, 0.5, 1.0, 2.0])


VIEWED = f"""{LONG}, viewed AS (SELECT long.*, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS n_views FROM long JOIN events ON event_id = visit_id)"""


def _best_path_sql(p: H.HmmParams) -> str:
    """The best path by a recursion over the visits of every path; NEVER stands for what the model forbids."""
    k, units = range(p.states), lambda v: H._units(v).tolist()
    start, trans, end = units(p.start), units(p.trans), units(p.end)
    raw = [f"(o * ln({float(r)!r}::DOUBLE) - {float(r)!r}::DOUBLE)" for r in p.rates]
    emit = ", ".join(f"CAST(floor(({x} - greatest({', '.join(raw)})) * {H.SCORE} + 0.5) AS BIGINT) AS e{j}" for j, x in enumerate(raw))
    top = lambda j: f"greatest({', '.join(f'v{i} + {trans[i][j]}' for i in k)})"
    came = lambda j: "CASE " + " ".join(f"WHEN v{i} + {trans[i][j]} = {top(j)} THEN p{i}" for i in k) + f" END || '{j}'"
    last = f"greatest({', '.join(f'v{j} + {end[j]}' for j in k)})"
    return f"""WITH RECURSIVE {VIEWED},
ob AS MATERIALIZED (SELECT gid, conv_group, pos, n_touches, o, {emit} FROM (SELECT gid, conv_group, pos, n_touches, n_views::DOUBLE AS o FROM viewed)),
go AS (
  SELECT gid, conv_group, pos, n_touches, {', '.join(f"greatest({start[j]} + e{j}, {H.NEVER}) AS v{j}, '{j}' AS p{j}" for j in k)} FROM ob WHERE pos = 1
  UNION ALL
  SELECT go.gid, go.conv_group, ob.pos, go.n_touches, {', '.join(f"greatest({top(j)} + e{j}, {H.NEVER}), {came(j)}" for j in k)}
  FROM go JOIN ob ON go.gid = ob.gid AND go.conv_group = ob.conv_group AND ob.pos = go.pos + 1),
fin AS (SELECT gid, conv_group, CASE {' '.join(f"WHEN {last} > {H.NEVER // 2} AND v{j} + {end[j]} = {last} THEN p{j}" for j in k)} END AS path FROM go WHERE pos = n_touches)
SELECT ob.gid, ob.conv_group, ob.pos, o AS obs, CAST(substr(path, CAST(ob.pos AS INTEGER), 1) AS INTEGER) AS state FROM ob JOIN fin ON ob.gid = fin.gid AND ob.conv_group = fin.conv_group"""


@query("m23_best_path", _best_path_sql(FUNNEL))
def m23_best_path(t):
    """Most probable states of every path under the funnel as it is given; paths it rules out have none."""
    return as_int(H.hmm_best_path(_views(t), FUNNEL, PATH_KEYS), "conv_group")


def _fits(t):
    """Both models, fitted: the funnel from its weights, and one without a topology."""
    v = _views(t)
    return {"funnel": H.hmm_fit(v, PATH_KEYS, start=FUNNEL), "free": H.hmm_fit(v, PATH_KEYS)}


@query("m23_two_models")
def m23_models(t):
    """Parameters and log-likelihood by round of the two models side by side."""
    rows = [(name, *r) for name, (p, history) in _fits(t).items()
            for r in [*H.parameter_rows(p), *(("loglik", i, -1, h) for i, h in enumerate(history))]]
    return rounded(t.spark.createDataFrame(rows, "model string, kind string, from_state int, to_state int, value double"), "value", digits=4)


@query("m23_hmm_decode")
def m23(t):
    v = _views(t)
    return rounded(H.hmm_decode(v, H.hmm_fit(v, PATH_KEYS)[0], PATH_KEYS), "posterior")


def _decoded(t):
    v = _views(t)
    return store(H.hmm_decode(v, H.hmm_fit(v, PATH_KEYS)[0], PATH_KEYS).withColumnRenamed("obs", "_obs").join(v, [*PATH_KEYS, "pos"]))


MEASURES = ["n_views", "is_to_cart"]


@query("m23_decoded_by_state")
def m23_by_state(t):
    return rounded(H.state_summary(_decoded(t), "state", MEASURES), "mean_n_views", "mean_is_to_cart", digits=4)


@query("m23_decoded_by_medium")
def m23_by_medium(t):
    """Visits of each medium per decoded state."""
    return _decoded(t).groupBy("medium", "state").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("posterior"), 4).alias("posterior"))


@query("m23_decoded_by_client")
def m23_by_client(t):
    return _decoded(t).groupBy("gid").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("state"), 4).alias("mean_state"),
                                          *[F.count_if(F.col("state") == s).alias(f"state_{s}") for s in range(4)])


@query("m23_decoded_by_order")
def m23_by_order(t):
    """Per client and number of earlier orders: mean state, views and cart visits, and the value."""
    known = F.when(F.col("value") >= 0, F.col("value"))
    out = _decoded(t).groupBy("gid", F.col("conv_group").alias("num_orders")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("state").alias("mean_state"), F.avg("n_views").alias("mean_n_views"), F.avg("is_to_cart").alias("mean_is_to_cart"),
        F.count(known).alias("value_count"), F.sum(known).alias("value_sum"), F.avg(known).alias("value_mean"))
    return rounded(out, "mean_state", "mean_n_views", "mean_is_to_cart", "value_sum", "value_mean", digits=4)


@query("m23_values_by_order", f"""WITH {VIEWED} SELECT gid, CAST(conv_group AS BIGINT) AS num_orders, count(*) AS n, round(avg(n_views), 4) AS mean_n_views,
  count(value) FILTER (value >= 0) AS value_count, round(sum(value::DOUBLE) FILTER (value >= 0), 4) AS value_sum FROM viewed GROUP BY 1, 2""")
def m23_values(t):
    """The part of ``m23_decoded_by_order`` that does not depend on the fit."""
    return as_int(m23_by_order(t).select("gid", "num_orders", "n", "mean_n_views", "value_count", "value_sum"), "num_orders")


@query("m23_visits_by_client", f"WITH {LONG} SELECT gid, count(*) AS n FROM long GROUP BY 1")
def m23_visits(t):
    """Every visit is decoded exactly once."""
    return _decoded(t).groupBy("gid").agg(F.count("state").alias("n"))


@query("m23_state_summary", f"""WITH bp AS ({_best_path_sql(FUNNEL)}) SELECT state, count(*) AS n, round(avg(obs), 4) AS mean_obs, round(quantile_cont(obs, 0.5), 4) AS median_obs FROM bp GROUP BY 1""")
def m23_summary(t):
    """Visits by best-path state with mean and median views; paths without one under a null state."""
    out = store(H.hmm_best_path(_views(t), FUNNEL, PATH_KEYS)).withColumn("state", F.coalesce("state", F.lit(-1)))
    out = H.state_summary(out, "state", ["obs"]).withColumn("state", F.when(F.col("state") >= 0, F.col("state")))
    return rounded(out, "mean_obs", "median_obs", digits=4)
