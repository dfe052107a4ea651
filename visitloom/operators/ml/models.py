"""Feature pipelines, classifiers, search, calibration and batch scoring on ``pyspark.ml``."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import (CountVectorizer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def feature_stages(numeric=(), categorical=(), tokens: str | None = None, scale: bool = False,
                   vocab: int = 500, out: str = "features") -> list:
    """Indexers with an extra class for unknown and missing values, one-hot, tokens, assembler."""
    stages, parts = [], list(numeric)
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=[f"{c}_ix" for c in categorical],
                                    handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{c}_ix" for c in categorical],
                                    outputCols=[f"{c}_oh" for c in categorical], handleInvalid="keep", dropLast=False))
        parts += [f"{c}_oh" for c in categorical]
    if tokens:
        stages.append(CountVectorizer(inputCol=tokens, outputCol=f"{tokens}_tf", vocabSize=vocab))
        parts.append(f"{tokens}_tf")
    raw = f"{out}_raw" if scale else out
    stages.append(VectorAssembler(inputCols=parts, outputCol=raw, handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol=raw, outputCol=out, withMean=False))
    return stages


def classifier(kind: str, label: str = "label", weight: str | None = None, seed: int = 42, **params):
    common = {"labelCol": label, "featuresCol": "features"}
    if weight:
        common["weightCol"] = weight
    if kind == "gbt":
        return GBTClassifier(seed=seed, **{"maxIter": 10, "maxDepth": 3, **params}, **common)
    if kind == "forest":
        return RandomForestClassifier(seed=seed, **{"numTrees": 20, "maxDepth": 5, **params}, **common)
    if kind == "logistic":
        return LogisticRegression(**{"maxIter": 20, "regParam": 0.01, **params}, **common)
    if kind == "gbt_multiclass":
        inner = GBTClassifier(seed=seed, **{"maxIter": 5, "maxDepth": 3, **params})
        return OneVsRest(classifier=inner, labelCol=label, featuresCol="features")
    if kind == "kmeans":
        return KMeans(featuresCol="features", seed=seed, **{"k": 2, **params})
    raise ValueError(f"unknown model kind {kind}")


def fit(kind: str, df: DataFrame, stages: list, label: str = "label", weight: str | None = None,
        **params) -> PipelineModel:
    return Pipeline(stages=[*stages, classifier(kind, label, weight, **params)]).fit(df)


def positive_score(c: str = "probability"):
    return vector_to_array(F.col(c))[1]


def weight_sweep(kind: str, df: DataFrame, stages: list, label: str = "label", weights=range(1, 10),
                 **params) -> dict[int, PipelineModel]:
    """One model per positive-class weight."""
    out = {}
    for w in weights:
        weighted = df.withColumn("_w", F.when(F.col(label) == 1, float(w)).otherwise(1.0))
        out[w] = fit(kind, weighted, stages, label, "_w", **params)
    return out


def search(df: DataFrame, stages: list, kind: str, space: dict, draws: int = 4, folds: int = 2, seed: int = 42,
           label: str = "label", parallelism: int = 4):
    """Random draws from a parameter space, judged by k-fold AUC.

    ``space`` maps a parameter to ``("int", lo, hi)``, ``("real", lo, hi)``, ``("log", lo, hi)`` or
    ``("choice", [..])``.
    """
    rng, est = random.Random(seed), classifier(kind, label)

    def draw(spec):
        if spec[0] == "int":
            return rng.randint(spec[1], spec[2])
        if spec[0] == "real":
            return rng.uniform(spec[1], spec[2])
        if spec[0] == "log":
            return spec[1] * (spec[2] / spec[1]) ** rng.random()
        return rng.choice(spec[1])

    grid = [{est.getParam(k): draw(v) for k, v in space.items()} for _ in range(draws)]
    cv = CrossValidator(estimator=Pipeline(stages=[*stages, est]), estimatorParamMaps=grid, numFolds=folds,
                        seed=seed, parallelism=parallelism,
                        evaluator=BinaryClassificationEvaluator(labelCol=label))
    return cv.fit(df)


def search_table(spark, model) -> DataFrame:
    rows = [({p.name: float(v) for p, v in g.items() if isinstance(v, (int, float))}, float(m))
            for g, m in zip(model.getEstimatorParamMaps(), model.avgMetrics)]
    return spark.createDataFrame(rows, "params map<string,double>, auc double")


def calibrate(scored: DataFrame, label: str = "label", score: str = "score"):
    """Isotonic map to probabilities, fitted on scores of rows the model has not seen (``out_of_fold``)."""
    return IsotonicRegression(labelCol=label, featuresCol=score, predictionCol="calibrated").fit(
        scored.withColumn(label, F.col(label).cast("double")))


def out_of_fold(df: DataFrame, stages: list, kind: str, id_col: str, folds: int = 5, label: str = "label", **params) -> DataFrame:
    """Scores (id, label, fold, score) of every row by a model that has not seen it; folds by a hash of the id."""
    fold = F.pmod(F.xxhash64(id_col), F.lit(folds))
    parts = []
    for i in range(folds):
        model = fit(kind, df.filter(fold != i), stages, label, **params)
        parts.append(model.transform(df.filter(fold == i)).select(id_col, label, F.lit(i).alias("fold"), positive_score().alias("score")))
    return reduce(DataFrame.unionByName, parts)


def batch_score(models: dict[str, PipelineModel], df: DataFrame, id_col: str,
                names=("no", "yes")) -> DataFrame:
    """Label text and confidence (3 decimals) per horizon, side by side.

    Each model adds its columns to the same rows, so there is nothing to join.
    """
    out = df
    for horizon, model in models.items():
        before = out.columns
        scored = model.transform(out)
        probs = vector_to_array(F.col("probability"))
        ix = F.col("prediction").cast("int")
        out = scored.select(*before, F.get(F.array(*[F.lit(n) for n in names]), ix).alias(f"pred_{horizon}"),
                            F.round(F.get(probs, ix), 3).alias(f"conf_{horizon}"))
    cols = [c for h in models for c in (f"pred_{h}", f"conf_{h}")]
    return out.select(id_col, *cols)


def feature_names(scored: DataFrame, features: str = "features") -> list[str]:
    attrs = scored.schema[features].metadata["ml_attr"]["attrs"]
    flat = [a for group in attrs.values() for a in group]
    return [a["name"] for a in sorted(flat, key=lambda a: a["idx"])]


def importance(model: PipelineModel, scored: DataFrame) -> DataFrame:
    """Feature importances by name, largest first (the table has one row per feature)."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(feature_names(scored), values)]
    return scored.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature")


def mean_term_weight(df: DataFrame, tokens: str, terms: int = 500) -> DataFrame:
    """Average tf-idf weight over all documents of the ``terms`` most frequent terms: ``term, weight``.

    The weight of a term in a document is its count times ln((documents + 1) / (documents with it + 1)), so the
    mean needs only two counts per term. Equal frequencies are ranked by the term.
    """
    docs = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    per = (df.select(F.monotonically_increasing_id().alias("_d"), F.col(tokens).alias("_w")).select("_d", F.explode("_w").alias("term"))
           .groupBy("term").agg(F.count(F.lit(1)).alias("_tf"), F.countDistinct("_d").alias("_df")))
    top = per.orderBy(F.desc("_tf"), "term").limit(terms)
    return top.select("term", (F.col("_tf") / docs * F.ln((docs + 1) / (F.col("_df") + 1))).alias("weight"))


def vocabulary(df: DataFrame, id_col: str, tokens: str, terms: int = 500) -> DataFrame:
    """The ``terms`` most frequent terms (ties by term): term, index from 0 on, documents with it."""
    per = (df.select(F.col(id_col).alias("_d"), F.explode(tokens).alias("term")).groupBy("term")
           .agg(F.count(F.lit(1)).alias("_tf"), F.countDistinct("_d").alias("docs")))
    top = per.orderBy(F.desc("_tf"), "term").limit(terms)
    return top.select("term", (F.row_number().over(W.orderBy(F.desc("_tf"), "term")) - 1).alias("index"), "docs")


def document_vectors(df: DataFrame, id_col: str, tokens: str, vocab: DataFrame, n_docs: int) -> DataFrame:
    """Sparse tf-idf vectors as rows (id, term, index, weight), of Euclidean length 1 per document.

    A weight is the term's count in the document times ln((1 + n_docs) / (1 + docs)) + 1, over the document's
    length. Counts per (document, term) are aggregated before anything else, and the vocabulary is bounded, so it
    is broadcast; a document has at most as many rows as the vocabulary. Ids must be unique.
    """
    counts = df.select(id_col, F.explode(tokens).alias("term")).join(F.broadcast(vocab), "term").groupBy(id_col, "term", "index", "docs").agg(F.count(F.lit(1)).alias("_tf"))
    raw = F.col("_tf") * (F.ln(F.lit(1.0 + n_docs) / (1 + F.col("docs"))) + 1)
    rows = counts.withColumn("_raw", raw)
    length = F.sqrt(F.sum(F.col("_raw") ** 2).over(W.partitionBy(id_col)))
    return rows.select(id_col, "term", "index", (F.col("_raw") / length).alias("weight"))


def as_features(vectors: DataFrame, id_col: str, terms: int) -> DataFrame:
    """One ``features`` vector per document from its (index, weight) rows, at most ``terms`` of them."""
    from pyspark.ml.functions import array_to_vector

    held = vectors.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("index", "weight"))).alias("_m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(terms - 1)), lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0.0)))
    return held.select(id_col, array_to_vector(values).alias("features"))


def cluster_vs_label(clustered: DataFrame, label: str) -> DataFrame:
    return clustered.groupBy(F.col("prediction").alias("cluster"), F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
