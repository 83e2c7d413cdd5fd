"""Hashed n-gram features and small linear models.

A text is a few blocks of hashed n-grams (characters of some lengths, words, word pairs).
Its value in a block is the share of the block's n-grams that fall on a hash slot, so a
model's margin is the sum over blocks of the *mean* weight of the block's n-grams: scoring
is one gather per block, without building a vector, and independent of the text length.

Models are fitted on a bounded sample of labelled rows (documented ``per_class`` rows of
each class, chosen by a hash of the id) whose sparse features Spark computes; the descent
itself is a few numpy products over that sample."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canframes.llm.common import map_batches

_MUL = np.uint32(0x9E3779B1)
_MIX = np.uint32(0x85EBCA6B)


def _mix(h: np.ndarray, salt: int, dims: int) -> np.ndarray:
    h = (h ^ np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF)) * _MIX
    h ^= h >> np.uint32(15)
    h *= _MUL
    return ((h ^ (h >> np.uint32(13))) & np.uint32(dims - 1)).astype(np.int32)


def char_slots(raw: bytes, n: int, dims: int) -> np.ndarray:
    """Hash slots of the byte n-grams of ``raw``."""
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    if len(b) < n:
        return np.zeros(0, dtype=np.int32)
    h = b[: len(b) - n + 1].copy()
    for k in range(1, n):
        h *= _MUL
        h += b[k : len(b) - n + 1 + k]
    return _mix(h, n, dims)


def word_slots(words: list[bytes], dims: int) -> list[np.ndarray]:
    """Hash slots of the words and of the pairs of neighbouring words."""
    h = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
    return [_mix(h, 11, dims), _mix(h[:-1] * _MUL + h[1:], 12, dims) if len(h) > 1 else np.zeros(0, dtype=np.int32)]


def margins(blocks: list[np.ndarray], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Margins of one text for ``weights`` (models, dims)."""
    out = bias.astype(np.float64).copy()
    for s in blocks:
        if len(s):
            out += weights[:, s].mean(axis=1, dtype=np.float64)
    return out


def sparse(blocks: list[np.ndarray], dims: int) -> tuple[list[int], list[float]]:
    """The same features as (slots, values), for fitting."""
    v = np.zeros(dims, dtype=np.float32)
    for s in blocks:
        if len(s):
            v += np.bincount(s, minlength=dims).astype(np.float32) / np.float32(len(s))
    at = np.flatnonzero(v)
    return at.tolist(), v[at].tolist()


@dataclass
class Sample:
    """Sparse rows of a bounded sample (CSR) with class and hash-chosen fold."""

    labels: list
    fold: np.ndarray
    row: np.ndarray
    col: np.ndarray
    val: np.ndarray
    dims: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.val * w[self.col], minlength=len(self.labels))

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=self.val * g[self.row], minlength=self.dims)

    def part(self, keep: np.ndarray) -> Sample:
        number = (np.cumsum(keep) - 1).astype(np.int32)
        m = keep[self.row]
        return Sample([x for x, k in zip(self.labels, keep, strict=True) if k], self.fold[keep], number[self.row[m]], self.col[m], self.val[m], self.dims)


def bounded_sample(docs: DataFrame, ids: DataFrame, per_class: int, blocks_of, dims: int) -> Sample:
    """Features of at most ``per_class`` rows of each class: the ids (doc_id, label) with
    the smallest hashes, each id once. At most classes * per_class ids reach the driver and
    are joined as a broadcast table of that proven size; the texts stay on the executors."""
    spark = docs.sparkSession
    ids = ids.filter("doc_id IS NOT NULL AND label IS NOT NULL")
    classes = sorted(r[0] for r in ids.select("label").distinct().collect())
    h = F.xxhash64("doc_id")
    chosen = [
        tuple(r)
        for c in classes
        for r in ids.filter(F.col("label") == F.lit(c)).groupBy("doc_id", "label").agg(h.alias("h")).orderBy("h", "doc_id").limit(per_class).collect()
    ]
    empty = Sample([], np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0), dims)
    if not chosen:
        return empty
    picked = spark.createDataFrame([(i, str(c), h % 5) for i, c, h in chosen], "doc_id long, label string, fold int")

    def run(rows):
        for r in rows:
            slots, values = sparse(blocks_of(r["text"]), dims)
            if slots:
                yield {"doc_id": r["doc_id"], "label": r["label"], "fold": r["fold"], "mark": zlib.crc32(r["text"].encode("utf-8")), "slots": slots, "vals": values}

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL").join(F.broadcast(picked), "doc_id")
    got = map_batches(src, "doc_id long, label string, fold int, mark long, slots array<int>, vals array<float>", run, ["doc_id", "label", "fold", "text"], 32).toArrow()
    order = got.select(["doc_id", "mark"]).combine_chunks()
    order = np.lexsort((order["mark"].to_numpy(), order["doc_id"].to_numpy()))
    if not len(order):
        return empty
    # row by row into arrays of the final size: the driver holds no second copy of the sample
    where = [(c, i) for c, chunk in enumerate(got["slots"].chunks) for i in range(len(chunk))]
    slots, vals = got["slots"].chunks, got["vals"].chunks
    sizes = np.concatenate([c.value_lengths().to_numpy() for c in slots])[order]
    col, val = np.empty(sizes.sum(), dtype=np.int32), np.empty(sizes.sum(), dtype=np.float32)
    ends = np.cumsum(sizes)
    for k, end in zip(order.tolist(), ends.tolist(), strict=True):
        c, i = where[k]
        part = slots[c][i].values.to_numpy()
        col[end - len(part) : end], val[end - len(part) : end] = part, vals[c][i].values.to_numpy()
    ids_, fold, labels = got["doc_id"].to_numpy()[order], got["fold"].to_numpy()[order], got["label"].to_pylist()
    s = Sample([labels[k] for k in order.tolist()], fold, np.repeat(np.arange(len(order), dtype=np.int32), sizes), col, val, dims)
    del got, slots, vals
    pa.default_memory_pool().release_unused()
    once = np.concatenate([[True], ids_[1:] != ids_[:-1]])  # a repeated id trains once
    return s if once.all() else s.part(once)


def _descend(s: Sample, slope, l2: float, steps: int, rate: float) -> tuple[np.ndarray, float]:
    """Adam on the weighted loss whose derivative in the margin is ``slope(margin)``."""
    w, b = np.zeros(s.dims), 0.0
    m, v, mb, vb = np.zeros(s.dims), np.zeros(s.dims), 0.0, 0.0
    for t in range(1, steps + 1):
        g = slope(s.dot(w) + b)
        gw, gb = s.back(g) + l2 * w, float(g.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return w, b


def _balance(y: np.ndarray) -> np.ndarray:
    """Weights that give both signs the same total, 1 in all."""
    return np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))


def fit_logistic(s: Sample, y: np.ndarray, l2: float = 1e-6, steps: int = 80, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Class-balanced logistic regression, ``y`` in {-1, 1}."""
    c = _balance(y)
    return _descend(s, lambda z: -c * y / (1 + np.exp(np.clip(y * z, -30, 30))), l2, steps, rate)


def fit_svm(s: Sample, y: np.ndarray, l2: float = 1e-6, steps: int = 80, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Class-balanced linear support vector machine (squared hinge), ``y`` in {-1, 1}."""
    c = _balance(y)
    return _descend(s, lambda z: -2 * c * y * np.maximum(0, 1 - y * z), l2, steps, rate)


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(a, b) of P(y = 1) = 1 / (1 + exp(-(a * margin + b))), by Newton steps on smoothed
    targets (so that a separable fold keeps finite values)."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - t), weight * np.maximum(p * (1 - p), 1e-6)
        H = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(H, [(g * margin).sum(), g.sum()])
        step /= max(1.0, np.abs(step).max())
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
