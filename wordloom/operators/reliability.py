"""Selective prediction: softmax scores, rank combination, sparse heads, contributions, permutation p-values."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def softmax(logits: DataFrame, by: str = "series") -> DataFrame:
    """``logits`` with p, shifted by the largest logit."""
    w = W.partitionBy(by)
    d = logits.withColumn("_e", F.exp(F.col("logit") - F.max("logit").over(w)))
    return d.withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def confidence(probs: DataFrame, by: str = "series") -> DataFrame:
    """(by, conf, entropy): minus the largest probability and the predictive entropy."""
    return probs.groupBy(by).agg((-F.max("p")).alias("conf"), (-F.sum(F.col("p") * F.log(F.col("p") + 1e-12))).alias("entropy"))


def percent_rank(rows: DataFrame, col: str, out: str) -> DataFrame:
    """``rows`` with the average-tie rank of ``col`` over n. Ranks come from counts by distinct value, not from sorting rows."""
    counts = rows.groupBy(col).agg(F.count("*").alias("_c"))
    w = W.orderBy(col)
    ranked = counts.select(col, (F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("_c") + (F.col("_c") + 1) / 2.0).alias("_r"), F.sum("_c").over(W.partitionBy()).alias("_n"))
    return rows.join(ranked, col).withColumn(out, F.col("_r") / F.col("_n")).drop("_r", "_n")


def combined(rows: DataFrame, a: str, b: str, out: str = "score") -> DataFrame:
    """Mean of the percent ranks of two scores, without fitting."""
    d = percent_rank(percent_rank(rows, a, "_a"), b, "_b")
    return d.withColumn(out, 0.5 * (F.col("_a") + F.col("_b"))).drop("_a", "_b")


def _scaled(rows: DataFrame, cols: list[str]) -> DataFrame:
    stats = rows.agg(*[F.avg(c).alias(f"{c}_m") for c in cols], *[F.stddev_pop(c).alias(f"{c}_s") for c in cols])
    d = rows.join(F.broadcast(stats))
    d = d.select(*[c for c in rows.columns if c not in cols], *[((F.col(c) - F.col(f"{c}_m")) / F.when(F.col(f"{c}_s") < 1e-6, 1.0).otherwise(F.col(f"{c}_s"))).alias(c) for c in cols])
    return VectorAssembler(inputCols=cols, outputCol="x").transform(d)


def sparse_classifier(rows: DataFrame, cols: list[str], target: str, fold: str = "fold", strengths: tuple[float, ...] = (0.03, 0.1, 0.3, 1.0)) -> tuple[DataFrame, float]:
    """((term, coef), chosen C): L1 logistic regression with balanced weights, C by cross-validated log loss over ``fold``; fewer than two usable folds give no terms."""
    n = rows.groupBy(target).count().collect()
    if len(n) < 2:
        return rows.sparkSession.createDataFrame([], "term string, coef double"), 0.0
    total = sum(r["count"] for r in n)
    weight = {r[target]: total / (len(n) * r["count"]) for r in n}
    d = _scaled(rows, cols).withColumn("w", F.when(F.col(target) == 1, weight.get(1, 1.0)).otherwise(weight.get(0, 1.0))).cache()
    folds = [r[0] for r in d.select(fold).distinct().orderBy(fold).collect()]
    fitted = lambda x, c: LogisticRegression(featuresCol="x", labelCol=target, weightCol="w", elasticNetParam=1.0, regParam=1.0 / (c * total), standardization=False, maxIter=60).fit(x)
    best = (float("inf"), strengths[0])
    for c in strengths:
        losses = []
        for f in folds:
            p = fitted(d.where(F.col(fold) != f), c).transform(d.where(F.col(fold) == f)).withColumn("q", F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.get(vector_to_array("probability"), F.lit(1)))))
            losses.append(p.agg(F.avg(F.when(F.col(target) == 1, -F.log("q")).otherwise(-F.log(1 - F.col("q"))))).first()[0])
        best = min(best, (sum(losses) / len(losses), c))
    coef = fitted(d, best[1]).coefficients.toArray().tolist()
    return rows.sparkSession.createDataFrame(list(zip(cols, coef, strict=True)), "term string, coef double"), best[1]


def sparse_regressor(rows: DataFrame, cols: list[str], target: str, penalty: float) -> DataFrame:
    """(term, coef): L1 linear regression on standardised columns."""
    m = LinearRegression(featuresCol="x", labelCol=target, elasticNetParam=1.0, regParam=penalty, standardization=False).fit(_scaled(rows, cols))
    return rows.sparkSession.createDataFrame(list(zip(cols, m.coefficients.toArray().tolist(), strict=True)), "term string, coef double")


def contributions(rows: DataFrame, coefs: DataFrame, id_: str = "id") -> DataFrame:
    """(id, term, part): coef x z of long features (id, term, z); the score is their sum."""
    return rows.join(F.broadcast(coefs), "term").select(id_, "term", (F.col("coef") * F.col("z")).alias("part"))


def top_terms(parts: DataFrame, k: int = 3, id_: str = "id") -> DataFrame:
    """(id, rank, term, part): the k largest positive parts of each row, ties by term."""
    w = W.partitionBy(id_).orderBy(F.desc(F.round("part", 9)), "term")
    return parts.where("part > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(id_, "rank", "term", "part")


def permutation_p(null: DataFrame, observed: float, col: str = "value") -> DataFrame:
    """One row p = (1 + #{null <= observed}) / (1 + m)."""
    return null.agg(((1.0 + F.sum((F.col(col) <= observed).cast("int"))) / (1.0 + F.count("*"))).alias("p"))
