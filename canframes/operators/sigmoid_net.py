"""The network of ``pyspark.ml``'s ``MultilayerPerceptronClassifier`` (sigmoid hidden layers,
softmax output, its seeded start weights), trained on rows that carry a number of copies.

A copy enters the mean loss as a weight, so a resampled training set is never written out, and
the model input is built inside the tasks (``unpacked``), so wide inputs such as windows stay as
small as the frames they are made of. The rows are landed as blocks of arrays; an evaluation is
one pass in which every task adds up loss and gradient in matrix products. The driver takes
limited-memory quasi-Newton steps with a strong Wolfe line search; only the parameter vector
moves between driver and tasks.
The trained weights go back into a ``pyspark.ml`` model for scoring and storing."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession

from canframes.operators.neural import unpack
from canframes.session import land

Block = tuple[np.ndarray, np.ndarray, np.ndarray]  # inputs, labels, copies
Value = tuple[float, np.ndarray]  # loss and gradient
MEMORY = 10  # curvature pairs
TOLERANCE = 1e-6
SETTLED = 20  # steps over which the loss must fall by the tolerance
ROWS = 512  # rows of one matrix product
GROUP_BLOCKS = 64  # blocks that a task decodes at once


def model_of(spark: SparkSession, layers: list[int], seed: int, theta: np.ndarray | None = None) -> MultilayerPerceptronClassificationModel:
    """The ``pyspark.ml`` model with the weights ``theta``, or with the seeded start weights."""
    rows = spark.createDataFrame([(Vectors.dense([0.0] * layers[0]), float(c)) for c in (0, 1)], ["features", "label"])
    net = MultilayerPerceptronClassifier(layers=layers, maxIter=0, seed=seed)
    return net.fit(rows, {net.initialWeights: Vectors.dense(theta)} if theta is not None else {})


def forward(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Margins of both classes, and what went into every layer."""
    into = []
    for k, (w, b) in enumerate(layers):
        into.append(x)
        x = x @ w
        x += b
        if k < len(layers) - 1:  # the sigmoid; far below zero the exponential is infinite and the result 0
            np.negative(x, out=x)
            with np.errstate(over="ignore"):
                np.exp(x, out=x)
            x += 1
            np.reciprocal(x, out=x)
    return x, into


def loss_and_gradient(x: np.ndarray, y: np.ndarray, copies: np.ndarray, theta: np.ndarray, sizes: list[tuple[int, int]]) -> Value:
    """Sum of the cross-entropies over all copies, and its gradient."""
    layers = unpack(theta, sizes)
    z, into = forward(x, layers)
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    total = p.sum(axis=1)
    at = np.arange(len(y))
    loss = float((copies * (np.log(total) - z[at, y])).sum())
    p /= total[:, None]
    p[at, y] -= 1
    back, grads = p * copies[:, None], []
    for k in range(len(layers) - 1, -1, -1):
        grads += [back.sum(axis=0), (into[k].T @ back).ravel()]
        if k:
            back = back @ layers[k][0].T
            back *= into[k]
            back *= 1 - into[k]
    return loss, np.concatenate(grads[::-1])


def packed(rows: DataFrame, read: Callable[[pa.RecordBatch], Iterator[tuple]], group_rows: int = GROUP_BLOCKS) -> DataFrame:
    """The landed blocks that ``read`` makes of the Arrow batches of ``rows``: tuples of arrays,
    one to a row, so that a pass reads them without conversion. A task decodes ``group_rows`` blocks at once."""

    def run(batches):
        for batch in batches:
            for block in read(batch):
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], names=["block"])

    return land(rows.mapInArrow(run, "block binary"), "net-blocks", group_rows=group_rows)


def evaluate(blocks: RDD, unpacked: Callable[[tuple], Block], theta: np.ndarray, sizes: list[tuple[int, int]]) -> Value:
    """Mean loss over all copies and its gradient, in one pass."""
    n = len(theta)
    shared = blocks.context.broadcast(theta)

    def run(part):
        total = np.zeros(n + 2)  # gradient, loss, copies
        for row in part:
            x, y, copies = unpacked(pickle.loads(row[0]))
            loss, grad = loss_and_gradient(x, y, copies, shared.value, sizes)
            total[:n] += grad
            total[n:] += loss, copies.sum()
        yield total

    parts = blocks.mapPartitions(run)
    total = parts.treeReduce(np.add) if parts.getNumPartitions() else np.zeros(n + 2)
    shared.destroy()
    if not total[n + 1]:
        raise ValueError("no rows to fit on")
    return total[n] / total[n + 1], total[:n] / total[n + 1]


def _direction(g: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Two-loop recursion over the curvature pairs (step, change of the gradient), newest last."""
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


def _cubic(a: tuple, b: tuple) -> float:
    """Least point of the cubic through two (place, value, slope), a tenth off either end."""
    (ta, va, da), (tb, vb, db) = sorted((a[:3], b[:3]))
    d1 = da + db - 3 * (va - vb) / (ta - tb)
    d2 = np.sqrt(max(0.0, d1 * d1 - da * db))
    t = tb - (tb - ta) * (db + d2 - d1) / (db - da + 2 * d2)
    return float(min(max(t, ta + 0.1 * (tb - ta)), ta + 0.9 * (tb - ta)))


def _line_search(f: Callable[[np.ndarray], Value], x: np.ndarray, at: Value, way: np.ndarray, t: float) -> tuple[np.ndarray, Value] | None:
    """A point along ``way`` that meets the strong Wolfe conditions (1e-4, 0.9), or None."""
    start, slope = at[0], float(at[1] @ way)
    if not slope < 0:
        return None

    def phi(t: float) -> tuple:
        point = x + t * way
        value = f(point)
        return t, value[0], float(value[1] @ way), point, value

    low, high = (0.0, start, slope), None
    for i in range(10):
        c = phi(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > start + 1e-4 * t * slope or (c[1] >= low[1] and i):
            high = c
            break
        if abs(c[2]) <= 0.9 * abs(slope):
            return c[3], c[4]
        if c[2] >= 0:
            low, high = c, low
            break
        low, t = c, 1.5 * t
    for _ in range(10 if high else 0):
        c = phi(_cubic(low, high))
        if c[1] > start + 1e-4 * c[0] * slope or c[1] >= low[1]:
            high = c
            continue
        if abs(c[2]) <= 0.9 * abs(slope):
            return c[3], c[4]
        if c[2] * (high[0] - low[0]) >= 0:
            high = low
        low = c
    return None


def minimize(f: Callable[[np.ndarray], Value], x: np.ndarray, max_iter: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, list[float]]:
    """The point reached and the losses on the way. Stops after ``max_iter`` steps, when the loss
    fell less than ``tolerance`` of its start over the last steps, when the gradient is small
    against the loss, or when the line search fails with a fresh history."""
    at = f(x)
    losses, pairs = [at[0]], []
    while len(losses) <= max_iter:
        if np.linalg.norm(at[1]) <= max(tolerance * abs(at[0]), 1e-8):
            break
        if len(losses) > SETTLED and max(losses[-SETTLED:]) - at[0] <= tolerance * abs(losses[0]):
            break
        way = _direction(at[1], pairs)
        found = _line_search(f, x, at, way, 1.0 if len(losses) > 1 else 1.0 / float(np.linalg.norm(way)))
        if found is None:
            if not pairs:
                break
            pairs = []
            continue
        s, dg = found[0] - x, found[1][1] - at[1]
        if s @ dg > 0:
            pairs = [*pairs, (s, dg)][-MEMORY:]
        x, at = found
        losses.append(at[0])
    return x, losses


def fit(blocks: DataFrame, unpacked: Callable[[tuple], Block], layers: list[int], max_iter: int, seed: int) -> MultilayerPerceptronClassificationModel:
    """Train on ``packed`` blocks, which ``unpacked`` turns into (inputs, labels 0 / 1, copies)."""
    spark = blocks.sparkSession
    start = model_of(spark, layers, seed).weights.toArray()
    sizes = list(zip(layers[:-1], layers[1:], strict=True))
    rows = blocks.rdd
    theta, _ = minimize(lambda t: evaluate(rows, unpacked, t, sizes), start, max_iter)
    return model_of(spark, layers, seed, theta)


def column_reader(features: list[str], label: str = "label", copies: str = "copies") -> Callable[[pa.RecordBatch], Iterator[Block]]:
    """Blocks of rows with one column per input."""

    def read(batch):
        x = np.column_stack([batch.column(c).to_numpy() for c in features])
        y, n = batch.column(label).to_numpy().astype(int), batch.column(copies).to_numpy().astype(float)
        for i in range(0, len(x), ROWS):
            yield x[i : i + ROWS], y[i : i + ROWS], n[i : i + ROWS]

    return read
