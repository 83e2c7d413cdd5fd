"""L2 logistic regression with class weights and a penalized bias, fitted by Newton's method
(IRLS). Objective, with x~ = [x, 1] and t in {0, 1}:

    0.5 * |beta|^2 + C * sum_i w_i * log(1 + exp(-(2 t_i - 1) * beta . x~_i))

The weighted rows are landed once; every iteration is one aggregate over them: the gradient (d + 1 sums) and the upper
triangle of the Hessian ((d + 1)(d + 2) / 2 sums); only that small system is solved on
the driver. This keeps the bias inside the penalty, which ``pyspark.ml`` does not offer.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canframes.operators.split import class_weights, with_class_weight
from canframes.schema import FEATURES, LOGREG_C
from canframes.session import land


def _margin(beta: np.ndarray, features: list[str]) -> Column:
    m = F.lit(float(beta[-1]))
    for c, b in zip(features, beta[:-1]):
        m = m + F.col(c).cast("double") * F.lit(float(b))
    return m


def _sigmoid(m: Column) -> Column:
    e = F.exp(-F.abs(m))
    return F.when(m >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))


def fit_irls(train: DataFrame, C: float = LOGREG_C, features: list[str] | None = None, max_iter: int = 25, tol: float = 1e-10) -> np.ndarray:
    """[w_1..w_d, b] for balanced class weights computed on ``train``."""
    features = features or FEATURES
    weighted = with_class_weight(train, class_weights(train))
    rows = land(weighted.select("label", "weight", *[F.col(c).cast("double").alias(c) for c in features]), "irls-rows")
    d = len(features) + 1
    cols = [F.col(c) for c in features] + [F.lit(1.0)]
    beta = np.zeros(d)
    for _ in range(max_iter):
        p = F.col("_p")
        r = F.col("weight") * (p - F.col("label").cast("double"))
        s = F.col("weight") * p * (F.lit(1.0) - p)
        held = rows.select("label", "weight", *features, _sigmoid(_margin(beta, features)).alias("_p"))
        held = held.select(*features, r.alias("_r"), s.alias("_s"))
        aggs = [F.sum(F.col("_r") * cols[j]).alias(f"g{j}") for j in range(d)]
        aggs += [F.sum(F.col("_s") * cols[j] * cols[k]).alias(f"h{j}_{k}") for j in range(d) for k in range(j, d)]
        row = held.agg(*aggs).first()  # one row of d + d(d+1)/2 numbers
        g = beta + C * np.array([row[f"g{j}"] for j in range(d)])
        H = np.eye(d)
        for j in range(d):
            for k in range(j, d):
                H[j, k] += C * row[f"h{j}_{k}"]
                H[k, j] = H[j, k]
        step = np.linalg.solve(H, g)
        beta = beta - step
        if np.max(np.abs(step)) < tol:
            break
    return beta


def predict_proba(df: DataFrame, beta: np.ndarray, features: list[str] | None = None) -> DataFrame:
    return df.withColumn("score", _sigmoid(_margin(beta, features or FEATURES)))
