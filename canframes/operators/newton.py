"""Linear classifiers fitted by Newton steps whose data side is one aggregate a round.

With x~ = [x, 1] (the intercept is penalized like any weight; ``intercept=False`` in the
penalty leaves it out), y in {-1, 1}, class weights w and margin m = beta . x~:

* squared hinge:  0.5 |beta|^2 + C * sum w * max(0, 1 - y m)^2
* L1 logistic:    |beta|_1      + C * sum w * log(1 + exp(-y m))

A round evaluates a trial point: loss, gradient and the upper triangle of the Hessian in one
pass (the squared hinge counts the rows inside the margin there, so the active set is that of
the point). If the objective fell enough the point is taken and the small system gives the
next one, else the step is halved. The L1 step minimizes the quadratic model plus the
penalty by coordinate descent on the aggregated Hessian (proximal Newton). Only
(d + 1)(d + 4) / 2 + 1 numbers reach the driver per round, whatever the number of rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canframes.operators.split import class_weights, with_class_weight
from canframes.schema import FEATURES, LOGREG_C
from canframes.session import land

MAX_ROUNDS = 100
TOLERANCE = 1e-8  # largest (sub)gradient entry per unit of sample weight


@dataclass
class LinearFit:
    """[w_1..w_d, b], the objective there, rounds (passes over the rows) and whether the
    (sub)gradient met the tolerance."""

    beta: np.ndarray
    objective: float
    rounds: int
    converged: bool
    features: list[str]

    def margin(self) -> Column:
        terms = [F.lit(float(b)) * F.col(c).cast("double") for c, b in zip(self.features, self.beta[:-1], strict=True)]
        return reduce(lambda a, b: a + b, terms, F.lit(float(self.beta[-1])))


def squared_hinge(m: Column, y: Column) -> tuple[Column, Column, Column]:
    """Loss, first and second derivative in the margin."""
    short = F.greatest(F.lit(0.0), 1.0 - y * m)
    return short * short, -2.0 * y * short, F.when(short > 0, 2.0).otherwise(0.0)


def logistic(m: Column, y: Column) -> tuple[Column, Column, Column]:
    e = F.exp(-F.abs(m))
    loss = F.greatest(F.lit(0.0), -y * m) + F.log1p(e)
    p = F.when(y * m >= 0, e / (1.0 + e)).otherwise(1.0 / (1.0 + e))  # share of the wrong side
    return loss, -y * p, p * (1.0 - p)


def _evaluate(rows: DataFrame, beta: np.ndarray, features: list[str], loss: Callable, C: float) -> tuple[float, np.ndarray, np.ndarray]:
    """C * sum of weighted losses, its gradient and Hessian, in one aggregate."""
    d = len(features) + 1
    m = LinearFit(beta, 0.0, 0, False, features).margin()
    value, slope, bend = loss(m, F.col("label") * 2.0 - 1.0)
    held = rows.select("weight", *features, value.alias("_v"), slope.alias("_s"), bend.alias("_h"))
    x = [*(F.col(c) for c in features), F.lit(1.0)]
    w = F.col("weight")
    sums = [F.sum(w * F.col("_v"))] + [F.sum(w * F.col("_s") * x[j]) for j in range(d)]
    sums += [F.sum(w * F.col("_h") * x[j] * x[k]) for j in range(d) for k in range(j, d)]
    got = [C * float(v) for v in held.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
    H = np.zeros((d, d))
    H[np.triu_indices(d)] = got[1 + d :]
    return got[0], np.array(got[1 : 1 + d]), H + np.triu(H, 1).T


def _soft(v: float, by: float) -> float:
    return np.sign(v) * max(0.0, abs(v) - by)


def _l1_step(beta: np.ndarray, g: np.ndarray, H: np.ndarray, l1: np.ndarray, sweeps: int = 1000) -> np.ndarray:
    """argmin over s of g.s + s.H.s / 2 + l1.|beta + s|, by coordinate descent."""
    s, Hs = np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(beta)):
            a = max(H[j, j], 1e-12)
            new = _soft(a * (beta[j] + s[j]) - (g[j] + Hs[j]), l1[j]) / a - beta[j]
            if new != s[j]:
                Hs += H[:, j] * (new - s[j])
                most, s[j] = max(most, abs(new - s[j])), new
        if most < 1e-13:
            break
    return s


def _fit(train: DataFrame, loss: Callable, l1: bool, C: float, features: list[str] | None, intercept: bool, max_rounds: int, tolerance: float) -> LinearFit:
    features = features or FEATURES
    weighted = with_class_weight(train, class_weights(train))
    rows = land(weighted.select("label", "weight", *[F.col(c).cast("double").alias(c) for c in features]), "newton-rows")
    d = len(features) + 1
    pen = np.ones(d)
    pen[-1] = float(intercept)
    penalty = (lambda b: float((pen * np.abs(b)).sum())) if l1 else (lambda b: 0.5 * float((pen * b * b).sum()))
    n = rows.agg(F.sum("weight")).first()[0]
    if not n:
        raise ValueError("no rows to fit on")

    def wrong(b: np.ndarray, g: np.ndarray) -> float:
        """Largest entry of the smallest subgradient, per unit of sample weight."""
        if l1:
            g = np.where(b != 0, g + pen * np.sign(b), np.sign(g) * np.maximum(0.0, np.abs(g) - pen))
        else:
            g = g + pen * b
        return float(np.abs(g).max()) / n

    def direction(b: np.ndarray, g: np.ndarray, H: np.ndarray) -> tuple[np.ndarray, float]:
        """The Newton step and the fall of the objective that its model promises."""
        if l1:
            s = _l1_step(b, g, H, pen)
            return s, float(g @ s) + penalty(b + s) - penalty(b)
        g = g + pen * b
        s = -np.linalg.lstsq(H + np.diag(pen), g, rcond=None)[0]
        return s, float(g @ s)

    beta = np.zeros(d)
    value, g, H = _evaluate(rows, beta, features, loss, C)
    value += penalty(beta)
    step, fall = direction(beta, g, H)
    size, rounds, off = 1.0, 1, wrong(beta, g)
    while off > tolerance and rounds < max_rounds and size > 1e-10:
        trial = beta + size * step
        v, tg, tH = _evaluate(rows, trial, features, loss, C)
        v += penalty(trial)
        rounds += 1
        if v <= value + 1e-4 * size * fall + 1e-12 * abs(value):
            beta, value, g, H, size = trial, v, tg, tH, 1.0
            step, fall = direction(beta, g, H)
            off = wrong(beta, g)
        else:
            size /= 2
    return LinearFit(beta, value, rounds, off <= tolerance, features)


def fit_squared_hinge(
    train: DataFrame, C: float = 1.0, features: list[str] | None = None, intercept: bool = True, max_rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE
) -> LinearFit:
    """Linear support vector machine: squared hinge, L2 penalty, balanced class weights."""
    return _fit(train, squared_hinge, False, C, features, intercept, max_rounds, tolerance)


def fit_l1_logistic(
    train: DataFrame, C: float = LOGREG_C, features: list[str] | None = None, intercept: bool = True, max_rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE
) -> LinearFit:
    """Logistic regression with an L1 penalty and balanced class weights."""
    return _fit(train, logistic, True, C, features, intercept, max_rounds, tolerance)


def decision_function(df: DataFrame, fit: LinearFit) -> DataFrame:
    return df.withColumn("score", fit.margin())


def predict_proba(df: DataFrame, fit: LinearFit) -> DataFrame:
    return df.withColumn("score", 1.0 / (1.0 + F.exp(-fit.margin())))
