"""Feed-forward binary classifier (ReLU hidden layers, sigmoid output) with class weights, a
validation part and early stop, trained data-parallel.

An epoch is one Arrow pass over the landed rows: every task adds up the weighted cross-entropy
and its gradient over its training rows and the plain cross-entropy over its validation rows,
Spark sums the tasks' vectors, and the driver takes a limited-memory quasi-Newton step (a full
pass gives an exact gradient, so curvature pairs are exact too; dropout, which makes the
objective random, is left out). Training stops when the validation loss has not improved for
``patience`` accepted steps, and the parameters with the least validation loss are kept.
Only the parameter vector (a few thousand numbers) moves between driver and tasks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canframes.operators.split import class_weights, with_class_weight
from canframes.schema import FEATURES, MLP_HIDDEN, SEED
from canframes.session import land

EPOCHS = 50
PATIENCE = 5
MEMORY = 10  # curvature pairs


def shapes(n_in: int, hidden: tuple[int, ...]) -> list[tuple[int, int]]:
    return list(zip([n_in, *hidden], [*hidden, 1], strict=True))


def unpack(theta: np.ndarray, sizes: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weights, bias) of every layer, as views of the flat vector."""
    out, at = [], 0
    for a, b in sizes:
        out.append((theta[at : at + a * b].reshape(a, b), theta[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def start(sizes: list[tuple[int, int]], seed: int) -> np.ndarray:
    """Seeded uniform weights scaled by fan-in and fan-out, zero biases."""
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in sizes:
        parts += [rng.uniform(-1, 1, a * b) * np.sqrt(6 / (a + b)), np.zeros(b)]
    return np.concatenate(parts)


def logits(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Output margin of each row, and what went into every layer."""
    into = []
    for k, (w, b) in enumerate(layers):
        into.append(x)
        x = x @ w + b
        if k < len(layers) - 1:
            x = np.maximum(x, 0)
    return x[:, 0], into


def loss_and_gradient(x: np.ndarray, y: np.ndarray, weight: np.ndarray, theta: np.ndarray, sizes: list[tuple[int, int]]) -> tuple[float, np.ndarray]:
    """Weighted sum of cross-entropies and its gradient."""
    layers = unpack(theta, sizes)
    z, into = logits(x, layers)
    p = 0.5 * (1 + np.tanh(z / 2))
    loss = float((weight * (np.maximum(z, 0) - y * z + np.log1p(np.exp(-np.abs(z))))).sum())
    back, grads = (weight * (p - y))[:, None], []
    for k in range(len(layers) - 1, -1, -1):
        grads += [back.sum(axis=0), (into[k].T @ back).ravel()]
        if k:
            back = (back @ layers[k][0].T) * (into[k] > 0)
    return loss, np.concatenate(grads[::-1])


def epoch(rows: DataFrame, features: list[str], theta: np.ndarray, sizes: list[tuple[int, int]]) -> tuple[float, np.ndarray, float]:
    """One pass over ``rows`` (label, weight, val, features): mean weighted training loss, its
    gradient, mean validation loss."""
    n = len(theta)

    def run(batches):
        total = np.zeros(n + 4)  # gradient, training loss and weight, validation loss and rows
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy() for c in features])
            y = batch.column("label").to_numpy().astype(float)
            val = batch.column("val").to_numpy(zero_copy_only=False)
            w = batch.column("weight").to_numpy()
            loss, grad = loss_and_gradient(x[~val], y[~val], w[~val], theta, sizes)
            total[:n] += grad
            total[n : n + 2] += loss, w[~val].sum()
            if val.any():
                z, _ = logits(x[val], unpack(theta, sizes))
                total[n + 2 :] += (np.maximum(z, 0) - y[val] * z + np.log1p(np.exp(-np.abs(z)))).sum(), val.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 4)), pa.array(total)], names=["i", "v"])

    got = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # one row per parameter
    total = np.zeros(n + 4)
    total[got["i"].to_numpy()] = got["v"].to_numpy()
    weight, n_val = total[n + 1], total[n + 3]
    return total[n] / weight, total[:n] / weight, total[n + 2] / n_val if n_val else float("nan")


@dataclass
class MLP:
    """Parameters with the least validation loss; ``trace`` has (training loss, validation loss)
    of the start and every accepted step, ``best`` its index."""

    features: list[str]
    sizes: list[tuple[int, int]]
    theta: np.ndarray
    trace: list[tuple[float, float]] = field(default_factory=list)
    best: int = 0
    epochs: int = 0
    stopped: str = ""

    def score(self) -> Column:
        theta, sizes = self.theta, self.sizes

        @F.pandas_udf("double")
        def run(payload: pd.DataFrame) -> pd.Series:
            z, _ = logits(payload.to_numpy(dtype="float64"), unpack(theta, sizes))
            return pd.Series(0.5 * (1 + np.tanh(z / 2)))

        return run(F.struct(*[F.col(c).cast("double").alias(c) for c in self.features]))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", self.score())


def training_rows(train: DataFrame, val: DataFrame | None, features: list[str]) -> DataFrame:
    """Training and validation rows with class weights of the training part, landed once."""
    cols = ["label", *[F.col(c).cast("double").alias(c) for c in features]]
    weights = class_weights(train)
    rows = with_class_weight(train, weights).select(*cols, F.col("weight").cast("double").alias("weight"), F.lit(False).alias("val"))
    if val is not None:
        rows = rows.unionByName(val.select(*cols, F.lit(1.0).alias("weight"), F.lit(True).alias("val")))
    return land(rows, "mlp-rows")


def _direction(g: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Two-loop recursion over the curvature pairs (step, change of the gradient)."""
    q, kept = g.copy(), []
    for s, dg in reversed(pairs):
        a = (s @ q) / (s @ dg)
        kept.append(a)
        q -= a * dg
    if pairs:
        s, dg = pairs[-1]
        q *= (s @ dg) / (dg @ dg)
    for (s, dg), a in zip(pairs, reversed(kept), strict=True):
        q += (a - (dg @ q) / (s @ dg)) * s
    return -q


def fit_mlp(
    train: DataFrame, val: DataFrame | None = None, hidden: tuple[int, ...] = MLP_HIDDEN, epochs: int = EPOCHS, patience: int = PATIENCE,
    features: list[str] | None = None, seed: int = SEED,
) -> MLP:
    """Fit on ``train`` (features and label 0 / 1), stop on the loss over ``val``; without ``val``
    the training loss stands in for it. No training rows raise an error."""
    features = features or FEATURES
    sizes = shapes(len(features), hidden)
    rows = training_rows(train, val, features)
    if rows.filter("NOT val").isEmpty():
        raise ValueError("no rows to fit on")
    theta = start(sizes, seed)
    loss, g, held = epoch(rows, features, theta, sizes)
    model = MLP(features, sizes, theta, [(loss, held if val is not None else loss)], epochs=1, stopped="epochs")
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    step, size = -g / max(1.0, float(np.linalg.norm(g))), 1.0
    while model.epochs < epochs:
        if size < 1e-8 or np.abs(g).max() < 1e-9:
            model.stopped = "flat"
            break
        trial = theta + size * step
        v, tg, tv = epoch(rows, features, trial, sizes)
        model.epochs += 1
        if not v <= loss + 1e-4 * size * float(g @ step):
            size /= 2
            continue
        s, dg = trial - theta, tg - g
        if s @ dg > 1e-12 * (dg @ dg):
            pairs = [*pairs, (s, dg)][-MEMORY:]
        theta, loss, g, size = trial, v, tg, 1.0
        step = _direction(g, pairs)
        if g @ step >= 0:
            pairs, step = [], -g
        model.trace.append((loss, tv if val is not None else loss))
        if model.trace[-1][1] < model.trace[model.best][1]:
            model.best, model.theta = len(model.trace) - 1, theta
        elif len(model.trace) - 1 - model.best >= patience:
            model.stopped = "patience"
            break
    return model
