"""Baselines: naive forecasts, ridge regression by normal equations, logistic regression from the built-in library."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.numeric import digits
from quarry.operators.evaluation import RETURNS_SQL, prediction_pairs
from quarry.operators.market import dig
from quarry.registry import query
from quarry.sources.market import DAILY_SQL, daily_bars


def fit_ridge(rows: DataFrame, features: list[str], target: str, penalty: float) -> dict[str, float]:
    """Weights and intercept of a ridge regression whose intercept is not penalised and whose features are not scaled.

    The products of all pairs of columns are one aggregation; the driver solves a system of as many rows as features.
    """
    names = [*features, "1"]
    column: dict[str, Column] = {n: F.col(n).cast("double") for n in features} | {"1": F.lit(1.0)}
    ok = rows.dropna(subset=[*features, target])
    sums = {(a, b): F.sum(column[a] * column[b]) for i, a in enumerate(names) for b in names[i:]}
    found = ok.agg(*[s.alias(f"x{i}") for i, s in enumerate(sums.values())], *[F.sum(column[a] * F.col(target)).alias(f"y{i}") for i, a in enumerate(names)]).first()
    at = {k: found[f"x{i}"] or 0.0 for i, k in enumerate(sums)}
    left = np.array([[at.get((a, b), at.get((b, a))) for b in names] for a in names], float) + penalty * np.diag([1.0] * len(features) + [0.0])
    right = np.array([found[f"y{i}"] or 0.0 for i in range(len(names))], float)
    w = np.linalg.lstsq(left, right, rcond=None)[0]
    return dict(zip([*features, "intercept"], w.tolist(), strict=True))


def predict_linear(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    value = F.lit(weights["intercept"])
    for name, w in weights.items():
        if name != "intercept":
            value = value + F.col(name) * w
    return rows.withColumn("prediction", value)


@query("ridge_baseline", f"WITH {DAILY_SQL} {RETURNS_SQL}, s AS (SELECT sum(p * p) + 1.0 AS a, sum(p) AS b, CAST(count(*) AS DOUBLE) AS n, sum(p * y) AS u, sum(y) AS v FROM pairs) SELECT {dig('(u * n - b * v) / (a * n - b * b)', 'weight', 6)}, {dig('(a * v - b * u) / (a * n - b * b)', 'intercept', 6)} FROM s")
def _ridge(spark, sf):
    w = fit_ridge(prediction_pairs(daily_bars(spark, sf)), ["p"], "y", 1.0)
    return spark.createDataFrame([(w["p"], w["intercept"])], "weight double, intercept double").select(digits("weight", 6).alias("weight"), digits("intercept", 6).alias("intercept"))


def naive_baseline(pairs: DataFrame, kind: str = "last") -> DataFrame:
    """Predictions of the last return, or of the mean of all returns before."""
    from quarry.operators.market import series

    if kind == "last":
        return pairs.withColumn("prediction", F.col("p"))
    return pairs.withColumn("prediction", F.avg("y").over(series().rowsBetween(-(1 << 31), -1)))


@query("naive_mean_baseline", f"WITH {DAILY_SQL} {RETURNS_SQL} SELECT symbol, ts, {dig('avg(y) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)', 'prediction', 7)} FROM pairs")
def _naive(spark, sf):
    return naive_baseline(prediction_pairs(daily_bars(spark, sf)), "mean").select("symbol", "ts", digits("prediction", 7).alias("prediction"))


def logistic_baseline(rows: DataFrame, features: list[str], label: str, iterations: int = 20):
    """A fitted logistic regression of the built-in machine-learning library."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    assembled = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(rows)
    return LogisticRegression(featuresCol="features", labelCol=label, maxIter=iterations).fit(assembled)


def boosted_baseline(rows: DataFrame, features: list[str], target: str, rounds: int = 20, depth: int = 3, seed: int = 1):
    """Fitted gradient-boosted trees of the built-in machine-learning library; rows with a null feature are left out. `transform` predicts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    trees = GBTRegressor(featuresCol="features", labelCol=target, maxIter=rounds, maxDepth=depth, seed=seed)
    return Pipeline(stages=[assembler, trees]).fit(rows)
