"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

A document is known by its id in stages that decide by id (near copies, decontamination): rows that repeat
an id share its decision, and rows without an id stay. All stages keep further columns as they are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.llm import decontaminate, jaccard, lines, mixing, toxicity
from visitloom.llm.common import aside, quoted, table
from visitloom.llm.queries import MIN_SITES
from visitloom.session import checkpoint_dir, store


def _as_before(out: DataFrame, back: dict[str, str], docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, those set aside under their own names again."""
    moved = {own: name for name, own in back.items()}
    return out.select(*[c.alias(n) for n, c in zip(docs.columns, quoted([moved.get(n, n) for n in docs.columns]))])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold. Learns from the labelled rows among ``docs``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    own, back = aside(docs, {"tox_score", "tox_spans"})
    return _as_before(toxicity.tag(own, model).filter(F.col("tox_score") < toxicity.THRESHOLD), back, docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site lines. A document of which nothing but blanks is left goes."""
    own, back = aside(docs, {"n_lines", "n_removed"})
    out = lines.strip_lines(own, MIN_SITES)
    out = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return _as_before(out.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))), back, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents linked by similar shingle sets, the one with the smallest id."""
    links = store(jaccard.link_documents(docs))
    out = docs.join(links.filter("doc_id <> class_id").select("doc_id").distinct(), "doc_id", "left_anti")
    twice = store(links.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_links").alias("links")).filter("n > 1 AND links > 0").select("doc_id"))
    if not twice.isEmpty():              # rows that repeat an id and its text
        once = out.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        out = out.join(twice, "doc_id", "left_anti").unionByName(once)
    return out.select(*quoted(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage occurs."""
    found = decontaminate.report(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.filter("contaminated").select("doc_id").distinct(), "doc_id", "left_anti").select(*quoted(docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document enters the mix, for all documents."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Learned scores and similarity classes are beyond SQL; tests/llm compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{checkpoint_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
