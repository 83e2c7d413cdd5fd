"""Online linear learners (perceptron, passive-aggressive, hinge descent with a decaying step)
trained by iterative parameter mixing: every epoch each partition runs one sequential pass
over its rows starting from the current weights (``mapInPandas``), and the new weights are
the row-weighted average of the partition results (one small aggregate; only d + 1 numbers
reach the driver). The step number of the hinge descent goes on over the epochs, by the
mean rows of a partition. Training stops when the mean loss met during an epoch has not
fallen by ``tol`` for ``patience`` epochs.

The partition layout is fixed (hash of the frame key into ``partitions``, rows inside a
partition in seeded shuffle order), so results are repeatable; they depend on that
layout, as any parameter-mixing scheme does. With one partition a fit is the plain
sequential algorithm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canframes.functions.hashing import shuffle_key
from canframes.operators.split import class_weights, with_class_weight
from canframes.schema import FEATURES, PA_C, PERCEPTRON_ALPHA, SEED, SGD_ALPHA, SGD_MAX_ITER, SGD_TOL
from canframes.session import cut_lineage

ALPHA = PERCEPTRON_ALPHA  # L2 strength of the perceptron
PATIENCE = 5  # epochs without improvement
LEAST_SIZE = 1e-9  # common factor of the weights below which it is multiplied in


def _first_step(alpha: float) -> float:
    """Step number the decaying step 1 / (alpha * t) starts from: the first step is about the
    size that weights of this penalty have."""
    return 1.0 / (alpha * np.sqrt(1.0 / np.sqrt(alpha)))


def _pass_fn(w0: np.ndarray, features: list[str], kind: str, t0: float = 0.0):
    d = len(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b, size = w0[:d].tolist(), float(w0[d]), 1.0  # the weights are size * w: a shrink of all is one product
        n, lost = 0, 0.0
        first = _first_step(SGD_ALPHA) + t0
        for pdf in batches:
            rows = pdf[features].to_numpy(dtype="float64").tolist()
            labels = np.where(pdf["label"].to_numpy() > 0, 1.0, -1.0).tolist()
            for i, (x, y, cw) in enumerate(zip(rows, labels, pdf["weight"].to_numpy(dtype="float64").tolist(), strict=True)):
                margin = y * (size * math.sumprod(w, x) + b)
                if kind == "perceptron":
                    size *= 1.0 - ALPHA
                    lost += max(0.0, -margin)
                    step = cw * y if margin <= 0 else 0.0
                elif kind == "sgd_hinge":  # step 1 / (alpha * t), t over all rows so far
                    eta = 1.0 / (SGD_ALPHA * (first + n + i))
                    size *= 1.0 - eta * SGD_ALPHA
                    lost += max(0.0, 1.0 - margin)
                    step = eta * cw * y if margin < 1 else 0.0
                else:  # passive-aggressive, hinge loss, PA-I step
                    loss = 1.0 - margin
                    lost += max(0.0, loss)
                    step = min(PA_C * cw, loss / (math.sumprod(x, x) + 1.0)) * y if loss > 0 else 0.0
                if step:
                    by = step / size
                    w = [a + by * v for a, v in zip(w, x)]
                    b += step
                if size < LEAST_SIZE:
                    w, size = [size * a for a in w], 1.0
            n += len(pdf)
        if n:
            yield pd.DataFrame({"w": [[*(size * a for a in w), b]], "n": [n], "lost": [lost]})

    return run


@dataclass
class OnlineFit:
    """[w_1..w_d, b], mean loss met in each epoch, and whether the tolerance stopped it."""

    w: np.ndarray
    losses: list[float] = field(default_factory=list)
    settled: bool = False


def run_online(
    train: DataFrame, kind: str = "perceptron", epochs: int = SGD_MAX_ITER, partitions: int | None = None, features: list[str] | None = None,
    seed: int = SEED, tol: float = SGD_TOL, patience: int = PATIENCE,
) -> OnlineFit:
    """Rounds of parameter mixing until the loss settles, at most ``epochs``. No rows raise an error."""
    features = features or FEATURES
    spark = train.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    weighted = with_class_weight(train, class_weights(train))
    layout = (
        weighted.select("frame_id", "label", "weight", *[F.col(c).cast("double").alias(c) for c in features])
        .repartition(parts, "frame_id")
        .sortWithinPartitions(shuffle_key("frame_id", seed))
    )
    layout = cut_lineage(layout)  # fixed layout, read once per epoch without recomputing the split
    fit, t, best, waited = OnlineFit(np.zeros(len(features) + 1)), 0.0, np.inf, 0
    while len(fit.losses) < epochs and not fit.settled:
        part = layout.mapInPandas(_pass_fn(fit.w, features, kind, t), "w array<double>, n long, lost double")
        avg = part.select(F.posexplode("w").alias("i", "v"), "n", "lost").groupBy("i").agg(
            (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"), F.sum("n").alias("n"), F.sum("lost").alias("lost"), F.count("*").alias("parts")
        )
        got = {r.i: r for r in avg.collect()}  # d + 1 rows
        if not got:
            raise ValueError("no rows to fit on")
        fit.w = np.array([got[i].v for i in range(len(features) + 1)])
        t += got[0].n / got[0].parts
        loss = got[0].lost / got[0].n
        waited = waited + 1 if loss > best - tol else 0
        best = min(best, loss)
        fit.losses.append(loss)
        fit.settled = waited >= patience
    return fit


def fit_online(
    train: DataFrame, kind: str = "perceptron", epochs: int = SGD_MAX_ITER, partitions: int | None = None, features: list[str] | None = None, seed: int = SEED
) -> np.ndarray:
    """Weights [w_1..w_d, b] of :func:`run_online`."""
    return run_online(train, kind, epochs, partitions, features, seed).w


def decision_function(df: DataFrame, w: np.ndarray, features: list[str] | None = None) -> DataFrame:
    features = features or FEATURES
    margin = F.lit(float(w[-1]))
    for c, wi in zip(features, w[:-1]):
        margin = margin + F.col(c) * F.lit(float(wi))
    return df.withColumn("score", margin)
