"""Extremely randomized trees, grown level by level for all trees at once.

Every open node draws a few non-constant features and one uniform cut between the least and
the largest value each has in the node. One pass over the rows per level (Arrow batches, joined
to larger blocks) deals the rows through the trees so far and adds the rows of an open node to the
two sides of its cuts: frames of each class, least and largest value of each feature. The tasks' sums are one
grouped aggregate of at most trees x open nodes x cuts x 2 rows; with them the driver keeps
the best valid cut of each node (weighted Gini) and knows the value ranges of the children.

All draws are digests of (seed, tree, node, feature), so a fit depends on the rows alone,
not on their order or partitions, and SQL can recompute it. The model is a table of nodes of
bounded size (trees x 2^depth); class weights enter through whole-number counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canframes.operators.split import class_weights
from canframes.schema import FEATURES, FOREST_MAX_DEPTH, FOREST_MIN_LEAF, FOREST_TREES, SEED
from canframes.session import land

MAX_DEPTH_LIMIT = 16
BLOCK_ROWS = 1 << 17  # rows that a task deals through the trees at once
NODE_SCHEMA = "tree int, node int, feature string, cut double, n0 long, n1 long, share double"


def _digest(seed: int, tree: int, node: int, feature: int, use: str) -> str:
    return hashlib.md5(f"{seed}:{tree}:{node}:{feature}:{use}".encode()).hexdigest()


def draw_cuts(seed: int, tree: int, node: int, lo: np.ndarray, hi: np.ndarray, n_features: int) -> list[tuple[int, float]]:
    """(feature, cut) of ``n_features`` non-constant features in drawn order."""
    open_ = [f for f in range(len(lo)) if hi[f] > lo[f]]
    chosen = sorted(open_, key=lambda f: _digest(seed, tree, node, f, "order"))[:n_features]
    out = []
    for f in chosen:
        u = int(_digest(seed, tree, node, f, "cut")[:13], 16) / 16**13
        cut = float(lo[f] + u * (hi[f] - lo[f]))
        out.append((f, cut if cut < hi[f] else float(lo[f])))
    return out


@dataclass
class ExtraTrees:
    """Fitted trees: arrays (trees, 2^(depth + 1)) by heap number (root 1, children 2i and
    2i + 1); feature -1 is a leaf, rows with a larger value than the cut go right."""

    features: list[str]
    feature: np.ndarray
    cut: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    weights: tuple[float, float]

    @property
    def depth(self) -> int:
        return self.feature.shape[1].bit_length() - 2

    def shares(self) -> np.ndarray:
        """Weighted share of class 1 in every node."""
        a0, a1 = self.weights[0] * self.n0, self.weights[1] * self.n1
        return np.divide(a1, a0 + a1, out=np.zeros_like(a0), where=a0 + a1 > 0)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The node table: one row per node, feature and cut null in leaves."""
        share = self.shares()
        rows = [
            (int(t), int(v), self.features[f] if (f := self.feature[t, v]) >= 0 else None, float(self.cut[t, v]) if f >= 0 else None, int(self.n0[t, v]), int(self.n1[t, v]), float(share[t, v]))
            for t, v in zip(*np.nonzero(self.n0 + self.n1), strict=True)
        ]
        return spark.createDataFrame(rows, NODE_SCHEMA)

    @classmethod
    def from_nodes(cls, nodes: DataFrame, features: list[str], weights: tuple[float, float]) -> ExtraTrees:
        """The model of a stored node table."""
        rows = nodes.collect()  # trees x 2^depth rows, as fitted
        if not rows:
            raise ValueError("a node table holds at least the root of a tree")
        shape = (max(r.tree for r in rows) + 1, 1 << max(r.node for r in rows).bit_length())
        m = cls(features, np.full(shape, -1, dtype=np.int16), np.zeros(shape), np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64), weights)
        for r in rows:
            m.n0[r.tree, r.node], m.n1[r.tree, r.node] = r.n0, r.n1
            if r.feature is not None:
                m.feature[r.tree, r.node], m.cut[r.tree, r.node] = features.index(r.feature), r.cut
        return m

    def score(self) -> Column:
        """Mean over the trees of the class-1 share in the row's leaf."""
        feature, cut, share, depth = self.feature, self.cut, self.shares(), self.depth

        @F.pandas_udf("double")
        def run(payload: pd.DataFrame) -> pd.Series:
            x = payload.to_numpy(dtype="float64")
            total = np.zeros(len(x))
            for t in range(len(feature)):
                total += share[t][_route(x, feature[t], cut[t], depth)]
            return pd.Series(total / len(feature))

        return run(F.struct(*[F.col(c).cast("double").alias(c) for c in self.features]))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("score", self.score())

    def importances(self) -> np.ndarray:
        """Mean over the trees of each feature's share of the tree's impurity decrease."""
        total = np.zeros(len(self.features))
        for t in range(len(self.feature)):
            own = np.zeros(len(self.features))
            for v in np.flatnonzero(self.feature[t] >= 0):
                sides = [(self.n0[t, c], self.n1[t, c]) for c in (v, 2 * v, 2 * v + 1)]
                own[self.feature[t, v]] += _decrease(*sides[1], *sides[2], *self.weights)
            total += own / own.sum() if own.sum() > 0 else own
        return total / total.sum() if total.sum() > 0 else total

    def importance_table(self, spark: SparkSession) -> DataFrame:
        rows = [(f, float(v)) for f, v in zip(self.features, self.importances(), strict=True)]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def _route(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, steps: int) -> np.ndarray:
    node, at = np.ones(len(x), dtype=np.int64), np.arange(len(x))
    for _ in range(steps):
        f = feature[node]
        node = np.where(f >= 0, 2 * node + (x[at, f] > cut[node]), node)
    return node


def _squares(a0: float, a1: float) -> float:
    return (a0 * a0 + a1 * a1) / (a0 + a1)


def _decrease(l0: int, l1: int, r0: int, r1: int, w0: float, w1: float) -> float:
    """Weighted Gini decrease of a cut: what the sides' squares have over the node's."""
    left, right = _squares(l0 * w0, l1 * w1), _squares(r0 * w0, r1 * w1)
    return left + right - _squares((l0 + r0) * w0, (l1 + r1) * w1)


def _leaves(x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(node, its rows) for every node of one tree that some row ends in; ``x`` has a row per
    feature. Each split deals the rows of its node only."""
    held = [(1, np.arange(x.shape[1]))]
    while held:
        node, own = held.pop()
        if not len(own):
            continue
        if (f := feature[node]) < 0:
            yield node, own
            continue
        right = x[f].take(own) > cut[node]
        held += [(2 * node + 1, own[right]), (2 * node, own[~right])]


def _blocks(batches: Iterator[pa.RecordBatch], features: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(values with a row per feature, label is 1) of about ``BLOCK_ROWS`` rows at a time."""
    held, n = [], 0

    def block():
        return np.stack([np.concatenate([b.column(c).to_numpy() for b in held]) for c in features]), np.concatenate([b.column("label").to_numpy() for b in held]) == 1

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK_ROWS:
            yield block()
            held, n = [], 0
    if n:
        yield block()


def _add_sums(x: np.ndarray, y: np.ndarray, feature: np.ndarray, cut: np.ndarray, slot: np.ndarray, cand_f: np.ndarray, cand_c: np.ndarray, count: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
    """Adds the rows of one block to the sums of the open nodes' cuts."""
    cuts = cand_f.shape[1]
    for t in np.flatnonzero((slot >= 0).any(axis=1)):
        for node, own in _leaves(x, feature[t], cut[t]):
            if (s := slot[t, node]) < 0:
                continue
            mine, positive = x.take(own, axis=1), y.take(own)
            for k in range(cuts):
                if (f := cand_f[s, k]) < 0:
                    continue
                right = mine[f] > cand_c[s, k]
                for side, part in enumerate((~right, right)):
                    if not (n := np.count_nonzero(part)):
                        continue
                    key, n1 = (s * cuts + k) * 2 + side, np.count_nonzero(positive & part)
                    values = mine.compress(part, axis=1)
                    count[key] += n - n1, n1
                    lo[key] = np.minimum(lo[key], values.min(axis=1))
                    hi[key] = np.maximum(hi[key], values.max(axis=1))


def _level_pass(rows: DataFrame, features: list[str], feature: np.ndarray, cut: np.ndarray, slot: np.ndarray, cand_f: np.ndarray, cand_c: np.ndarray):
    """Merged sums of one level: {key: (n0, n1, lo, hi)}, key = (slot * cuts + cut) * 2 + side."""
    d, cuts = len(features), cand_f.shape[1]
    n_keys = len(cand_f) * cuts * 2
    names = ["key", "n0", "n1", *[f"lo{i}" for i in range(d)], *[f"hi{i}" for i in range(d)]]

    def run(batches):
        count = np.zeros((n_keys, 2), dtype=np.int64)
        lo, hi = np.full((n_keys, d), np.inf), np.full((n_keys, d), -np.inf)
        for x, y in _blocks(batches, features):
            _add_sums(x, y, feature, cut, slot, cand_f, cand_c, count, lo, hi)
        met = np.flatnonzero(count.sum(axis=1))
        cols = [met, count[met, 0], count[met, 1], *lo[met].T, *hi[met].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=names)

    schema = "key long, n0 long, n1 long, " + ", ".join(f"{c} double" for c in names[3:])
    merged = rows.mapInArrow(run, schema).groupBy("key").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), *[F.min(c).alias(c) for c in names[3 : 3 + d]], *[F.max(c).alias(c) for c in names[3 + d :]]
    )
    return {r[0]: (r[1], r[2], np.array(r[3 : 3 + d]), np.array(r[3 + d :])) for r in merged.collect()}  # at most n_keys rows


def fit_extra_trees(
    train: DataFrame, n_trees: int = FOREST_TREES, max_depth: int = FOREST_MAX_DEPTH, min_leaf: int = FOREST_MIN_LEAF,
    features: list[str] | None = None, n_features: int | None = None, seed: int = SEED,
) -> ExtraTrees:
    """Trees on the rows of ``train`` (``features`` and ``label`` 0 / 1, no nulls) with balanced
    class weights. ``n_features`` features are drawn per node (default: the root of their number).
    A node stays a leaf at ``max_depth``, with one class, with fewer than twice ``min_leaf`` rows,
    or when each of its cuts leaves a side under ``min_leaf`` rows. No rows raise an error."""
    features = features or FEATURES
    if not 0 <= max_depth <= MAX_DEPTH_LIMIT:
        raise ValueError(f"max_depth is 0 to {MAX_DEPTH_LIMIT}")
    d = len(features)
    cuts = min(d, n_features or max(1, int(d**0.5)))
    rows = land(train.select(F.col("label").cast("int").alias("label"), *[F.col(c).cast("double").alias(c) for c in features]), "tree-rows")
    w = {r.label: (r.n, r.weight) for r in class_weights(rows).collect()}  # one row per class
    if not w or not set(w) <= {0, 1}:
        raise ValueError("labels 0 and 1 are needed")
    weights = tuple(float(w.get(c, (0, 1.0))[1]) for c in (0, 1))
    ends = rows.agg(*[F.min(c).alias(f"lo_{c}") for c in features], *[F.max(c).alias(f"hi_{c}") for c in features]).first()

    shape = (n_trees, 1 << (max_depth + 1))
    model = ExtraTrees(features, np.full(shape, -1, dtype=np.int16), np.zeros(shape), np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64), weights)
    model.n0[:, 1], model.n1[:, 1] = (w.get(c, (0,))[0] for c in (0, 1))
    open_ = {(t, 1): (np.array(ends[:d]), np.array(ends[d:])) for t in range(n_trees)}
    for _ in range(max_depth):
        drawn = {}
        for (t, v), (lo, hi) in open_.items():
            n0, n1 = int(model.n0[t, v]), int(model.n1[t, v])
            if n0 and n1 and n0 + n1 >= 2 * min_leaf and (mine := draw_cuts(seed, t, v, lo, hi, cuts)):
                drawn[t, v] = mine
        if not drawn:
            break
        slot = np.full(shape, -1, dtype=np.int32)
        cand_f, cand_c = np.full((len(drawn), cuts), -1, dtype=np.int16), np.zeros((len(drawn), cuts))
        for s, ((t, v), mine) in enumerate(drawn.items()):
            slot[t, v] = s
            for k, (f, c) in enumerate(mine):
                cand_f[s, k], cand_c[s, k] = f, c
        sums = _level_pass(rows, features, model.feature, model.cut, slot, cand_f, cand_c)
        open_ = {}
        for s, ((t, v), mine) in enumerate(drawn.items()):
            best = None
            for k, (f, c) in enumerate(mine):
                left, right = (sums.get((s * cuts + k) * 2 + side) for side in (0, 1))
                if not left or not right or min(left[0] + left[1], right[0] + right[1]) < min_leaf:
                    continue
                gain = _decrease(left[0], left[1], right[0], right[1], *weights)
                if best is None or gain > best[0]:
                    best = (gain, f, c, left, right)
            if best:
                _, model.feature[t, v], model.cut[t, v], *sides = best
                for child, (n0, n1, lo, hi) in zip((2 * v, 2 * v + 1), sides, strict=True):
                    model.n0[t, child], model.n1[t, child] = n0, n1
                    open_[t, child] = (lo, hi)
    return model
