"""Time to the second purchase: survival table, covariate model, concordance."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import AFTSurvivalRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from visitloom.functions.ordered import ALL, lay_track, lift_off, scan
from visitloom.session import store

# The weeks reported.
REPORT_WEEKS = (1, 4, 9, 13, 26, 52)


def weekly_durations(df: DataFrame, first: str, second: str, as_of: str) -> DataFrame:
    """``event`` (a second sale is known) and ``week`` (whole weeks, rounded up, to it or to ``as_of``)."""
    end = F.coalesce(F.col(second), F.to_date(F.lit(as_of)))
    return df.withColumns({"event": F.col(second).isNotNull().cast("int"),
                           "week": F.ceil(F.datediff(end, F.col(first)) / 7).cast("int")})


def survival_table(df: DataFrame, dur: str = "week", event: str = "event", by=()) -> DataFrame:
    """Kaplan-Meier: at-risk count, events and survival after each week.

    Rows are first reduced to one per group and week; a group then has as many rows as the study
    has weeks, which bounds the window.
    """
    keys = list(by) or [ALL]
    base = df if by else df.withColumn(ALL, F.lit(0))
    weeks = base.groupBy(*keys, F.col(dur).alias("week")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("long")).alias("events"))
    later = W.partitionBy(*keys).orderBy(F.col("week").desc())
    upto = W.partitionBy(*keys).orderBy("week")
    risk = weeks.withColumn("at_risk", F.sum("n").over(later))
    alive = 1 - F.col("events") / F.col("at_risk")
    log_s = F.sum(F.when(alive > 0, F.ln(alive))).over(upto)
    ended = F.max(F.when(alive <= 0, 1).otherwise(0)).over(upto)
    surv = F.when(ended == 1, 0.0).otherwise(F.exp(F.coalesce(log_s, F.lit(0.0))))
    return risk.withColumn("survival", surv).select(*by, "week", "at_risk", "events", "survival")


def survival_at(table: DataFrame, weeks=REPORT_WEEKS, by=()) -> DataFrame:
    """Survival at the reported weeks, one column each: the last table row not after the week."""
    cols = [F.coalesce(F.max_by("survival", F.when(F.col("week") <= w, F.col("week"))), F.lit(1.0)).alias(f"w{w}")
            for w in weeks]
    return table.groupBy(*by).agg(*cols)


def fit_survival(df: DataFrame, features: list[str], dur: str = "week", event: str = "event"):
    """Weibull accelerated-failure model; proportional-hazards coefficients are -coef / scale."""
    rows = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(
        df.withColumns({dur: F.greatest(F.col(dur), F.lit(1)).cast("double"), event: F.col(event).cast("double")}))
    return AFTSurvivalRegression(labelCol=dur, censorCol=event, featuresCol="features", maxIter=50).fit(rows)


def customer_survival(model, df: DataFrame, id_col: str, features: list[str], weeks=REPORT_WEEKS, keep=()) -> DataFrame:
    """Probability per customer to be without a second purchase after each week, one column per week.

    Under the Weibull model it is exp(-(week / predicted scale)^(1 / sigma)).
    """
    rows = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)
    at = [F.exp(-F.pow(F.lit(float(w)) / F.col("prediction"), F.lit(1.0 / model.scale))).alias(f"w{w}") for w in weeks]
    return model.transform(rows).select(id_col, *keep, *at)


def hazard_coefficients(model, features: list[str]) -> list[tuple[str, float]]:
    return [(f, -float(c) / model.scale) for f, c in zip(features, model.coefficients)]


def concordance(df: DataFrame, risk: str, dur: str = "week", event: str = "event", by=()) -> DataFrame:
    """Share of comparable pairs in which the earlier event has the higher risk (ties half), per group ``by``.

    Pairs are never built. "A later week" splits by the highest bit in which two weeks differ: the later
    one has it set and both agree above it. So each row enters one group per bit of the
    week, and a running sum over the risk in each group counts the later rows with a lower risk. Risks are
    compared as they are.
    """
    cells = store(df.filter(F.col(risk).isNotNull() & F.col(dur).isNotNull())
                  .groupBy(*by, F.col(dur).cast("long").alias("w"), F.col(risk).cast("double").alias("r"))
                  .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("long")).alias("e")))
    bits = max(1, int(cells.agg(F.max("w")).first()[0] or 0).bit_length())
    halves = cells.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    later = F.expr("shiftright(w, bit) & 1") == 1
    groups = halves.groupBy(*by, "bit", F.expr("shiftright(w, bit + 1)").alias("above"), "r").agg(
        F.coalesce(F.sum(F.when(later, F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~later, F.col("e"))), F.lit(0)).alias("e"))
    laid, track = lay_track(store(groups), [*by, "bit", "above"], ["r"])
    ranked = lift_off(scan(laid, track, lower=("prior_sum", "n")))
    per = ranked.groupBy(*by, "bit", "above").agg(
        (F.sum("e") * F.sum("n")).alias("pairs"), F.sum(F.col("e") * (F.col("lower") + F.col("n") / 2)).alias("good"))
    return (per.groupBy(*by) if by else per).agg(F.sum("pairs").alias("pairs"), F.try_divide(F.sum("good"), F.sum("pairs")).alias("c_index"))
