"""Discrimination of sequence sets by motifs: L1-regularised logistic regression with the one-standard-error rule."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAMBDAS = (0.1, 0.03, 0.01, 0.003, 0.001)


def discriminate(data: DataFrame, columns: list[str], label: str = "y", alpha: float = 1.0, folds: int = 5, metric: str = "areaUnderROC", lambdas: tuple[float, ...] = LAMBDAS) -> dict:
    """Cross-validated fit; the strongest penalty within a standard error of the best is used."""
    rows = VectorAssembler(inputCols=columns, outputCol="x").transform(data).withColumn("fold", F.pmod(F.xxhash64("seq"), F.lit(folds))).persist()
    judge = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", metricName=metric)
    table = []
    for lam in lambdas:
        found = []
        for k in range(folds):
            lr = LogisticRegression(featuresCol="x", labelCol=label, regParam=lam, elasticNetParam=alpha, standardization=False)
            found.append(judge.evaluate(lr.fit(rows.where(F.col("fold") != k)).transform(rows.where(F.col("fold") == k))))
        mean = sum(found) / folds
        table.append((lam, mean, (sum((x - mean) ** 2 for x in found) / max(1, folds - 1) / folds) ** 0.5))
    top = max(table, key=lambda t: t[1])
    lam = max(t[0] for t in table if t[1] >= top[1] - top[2])
    fit = LogisticRegression(featuresCol="x", labelCol=label, regParam=lam, elasticNetParam=alpha, standardization=False).fit(rows)
    auc = judge.evaluate(fit.transform(rows))
    rows.unpersist()
    weights = sorted(((c, float(w)) for c, w in zip(columns, fit.coefficients.toArray(), strict=True) if w), key=lambda x: -abs(x[1]))
    return {"lambda": lam, "auc": auc, "cv": table, "intercept": float(fit.intercept), "weights": weights}
