"""The weighted network: gradient against plain numpy, early stop, partition independence."""

from __future__ import annotations

import numpy as np
import pytest

from canframes.operators import neural as N

COLS = ["a", "b", "c"]


def data(spark, n=240, seed=1, parts=3):
    rng = np.random.default_rng(seed)
    X = rng.normal(0, 1, (n, 3))
    y = (X[:, 0] * X[:, 1] + 0.3 * X[:, 2] + rng.normal(0, 0.4, n) > 0.6).astype(int)
    df = spark.createDataFrame([(*map(float, x), int(t)) for x, t in zip(X, y, strict=True)], "a double, b double, c double, label int")
    return df.repartition(parts), X, y


def plain_loss(theta, X, y, w, hidden):
    """Mean weighted cross-entropy, layer by layer."""
    at, x = 0, X
    for k, width in enumerate([*hidden, 1]):
        W = theta[at : at + x.shape[1] * width].reshape(x.shape[1], width)
        b = theta[at + W.size : at + W.size + width]
        at += W.size + width
        x = x @ W + b
        if k < len(hidden):
            x = np.where(x > 0, x, 0)
    p = 1 / (1 + np.exp(-x[:, 0]))
    return -(w * np.where(y == 1, np.log(p), np.log(1 - p))).sum() / w.sum()


@pytest.mark.parametrize("hidden", [(5,), (6, 4)])
def test_gradient_equals_numpy_differences(spark, hidden):
    df, X, y = data(spark)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    sizes = N.shapes(3, hidden)
    theta = N.start(sizes, 5) + 0.05
    loss, g, held = N.epoch(N.training_rows(df, df.limit(50), COLS), COLS, theta, sizes)
    assert loss == pytest.approx(plain_loss(theta, X, y, w, hidden), abs=1e-12) and held > 0
    for i in range(0, len(theta), 3):
        e = np.zeros(len(theta))
        e[i] = 1e-6
        slope = (plain_loss(theta + e, X, y, w, hidden) - plain_loss(theta - e, X, y, w, hidden)) / 2e-6
        assert g[i] == pytest.approx(slope, abs=1e-7)


def test_same_sums_on_any_partitions(spark):
    sizes = N.shapes(3, (4,))
    theta = N.start(sizes, 2)
    sums = [N.epoch(N.training_rows(data(spark, parts=p)[0], None, COLS), COLS, theta, sizes) for p in (1, 7)]
    assert sums[0][0] == pytest.approx(sums[1][0], abs=1e-12) and np.allclose(sums[0][1], sums[1][1], atol=1e-12)
    assert np.isnan(sums[0][2])


def test_stops_on_validation_and_keeps_the_best(spark):
    df, _, _ = data(spark, 120, seed=3)
    val, X, y = data(spark, 200, seed=4)
    model = N.fit_mlp(df, val, hidden=(24, 12), epochs=60, patience=3, features=COLS)
    held = [v for _, v in model.trace]
    assert model.stopped == "patience" and model.best == held.index(min(held)) == len(held) - 4
    assert model.epochs < 60 and len(model.trace) > 4
    got = plain_loss(model.theta, X, y, np.ones(len(y)), (24, 12))
    assert got == pytest.approx(min(held), abs=1e-12)
    assert held[model.best] < held[0] and held[-1] > held[model.best]


def test_learns_what_a_linear_model_cannot(spark):
    df, X, y = data(spark, 600, seed=7)
    model = N.fit_mlp(df, None, hidden=(16,), epochs=60, features=COLS)
    rows = model.transform(df).select("label", "score").collect()
    assert np.mean([(r.score >= 0.5) == (r.label == 1) for r in rows]) > 0.85
    with pytest.raises(ValueError, match="no rows"):
        N.fit_mlp(df.limit(0), None, features=COLS)
