"""Newton-type linear learners against plain numpy minimizers of the same objectives."""

from __future__ import annotations

import numpy as np
import pytest

from canframes.operators import newton

COLS = ["a", "b", "c", "flat"]


def data(spark, n=300, seed=3, parts=4):
    rng = np.random.default_rng(seed)
    X = np.column_stack([rng.normal(0, 1, n), rng.integers(-2, 3, n) * 0.7, rng.normal(0, 1, n), np.full(n, 2.0)])
    y = (X[:, 0] - 0.4 * X[:, 1] + rng.normal(0, 0.8, n) > 0.5).astype(int)
    rows = [(*map(float, x), int(t)) for x, t in zip(X, y, strict=True)]
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    return spark.createDataFrame(rows, "a double, b double, c double, flat double, label int").repartition(parts), np.hstack([X, np.ones((n, 1))]), 2.0 * y - 1, w


def hinge_objective(b, X, y, w, C):
    return 0.5 * b @ b + C * (w * np.maximum(0, 1 - y * (X @ b)) ** 2).sum()


def l1_objective(b, X, y, w, C, pen):
    return (pen * np.abs(b)).sum() + C * (w * np.logaddexp(0, -y * (X @ b))).sum()


@pytest.mark.parametrize("C", [1.0, 0.01])
def test_squared_hinge_equals_gradient_descent(spark, C):
    df, X, y, w = data(spark)
    fit = newton.fit_squared_hinge(df, C, COLS)
    b = np.zeros(X.shape[1])
    rate = 1 / (1 + 2 * C * np.linalg.norm(X * np.sqrt(w)[:, None], 2) ** 2)
    v = b.copy()
    for k in range(20000):  # accelerated gradient, far past convergence
        g = v - 2 * C * X.T @ (w * y * np.maximum(0, 1 - y * (X @ v)))
        new = v - rate * g
        v, b = new + min(0.9, k / (k + 3)) * (new - b), new
    assert fit.converged and fit.rounds < 30
    assert np.allclose(fit.beta, b, atol=1e-6)
    assert fit.objective == pytest.approx(hinge_objective(b, X, y, w, C), rel=1e-9)


@pytest.mark.parametrize("C,intercept", [(1.0, True), (0.02, True), (0.02, False)])
def test_l1_logistic_equals_proximal_gradient(spark, C, intercept):
    df, X, y, w = data(spark, seed=5)
    fit = newton.fit_l1_logistic(df, C, COLS, intercept=intercept)
    pen = np.ones(X.shape[1])
    pen[-1] = float(intercept)
    b = np.zeros(X.shape[1])
    rate = 4 / (C * np.linalg.norm(X * np.sqrt(w)[:, None], 2) ** 2)
    for _ in range(30000):
        g = -C * X.T @ (w * y / (1 + np.exp(y * (X @ b))))
        b = b - rate * g
        b = np.sign(b) * np.maximum(0, np.abs(b) - rate * pen)
    assert fit.converged
    assert fit.objective <= l1_objective(b, X, y, w, C, pen) + 1e-6
    # the constant column and the intercept can share one value: compare what the rows see
    assert np.allclose(X @ fit.beta, X @ b, atol=1e-3)
    if C < 1:
        assert (fit.beta == 0).any()  # exact zeros


def test_margin_scores_and_edges(spark):
    df, X, _, _ = data(spark)
    fit = newton.fit_squared_hinge(df, features=COLS)
    got = newton.decision_function(df, fit).select("a", "b", "c", "score").collect()
    want = {tuple(x[:3]): x @ fit.beta for x in X}
    assert all(r.score == pytest.approx(want[r.a, r.b, r.c]) for r in got)
    one = newton.fit_squared_hinge(df.filter("label = 1"), features=COLS)
    assert one.converged and newton.decision_function(df, one).filter("score <= 0").count() < 300
    with pytest.raises(ValueError, match="no rows"):
        newton.fit_l1_logistic(df.limit(0), features=COLS)
