"""Extremely randomized trees against a plain recursive version over the same draws."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canframes.operators.extra_trees import ExtraTrees, fit_extra_trees

COLS = ["a", "b", "c", "d", "k"]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "a double, b double, c double, d double, k double, label int").repartition(parts)


def some_rows(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a, b, c, d = rng.gauss(0, 1), float(rng.randrange(4)), rng.random(), float(rng.randrange(2))
        out.append((a, b, c, d, 7.0, int(a + 0.5 * b + rng.gauss(0, 0.7) > 1)))
    return out


def hashed(seed, tree, node, f, use):
    return hashlib.md5(f"{seed}:{tree}:{node}:{f}:{use}".encode()).hexdigest()


def grow(rows, tree, node, depth, max_depth, min_leaf, n_features, seed, w, out):
    """Recursive growth over lists of rows."""
    n1 = sum(r[-1] for r in rows)
    out[tree, node] = [None, None, len(rows) - n1, n1]
    if depth == max_depth or n1 in (0, len(rows)) or len(rows) < 2 * min_leaf:
        return
    open_ = [f for f in range(len(COLS)) if len({r[f] for r in rows}) > 1]
    best = None
    for f in sorted(open_, key=lambda f: hashed(seed, tree, node, f, "order"))[:n_features]:
        lo, hi = min(r[f] for r in rows), max(r[f] for r in rows)
        cut = lo + int(hashed(seed, tree, node, f, "cut")[:13], 16) / 16**13 * (hi - lo)
        left, right = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
        if min(len(left), len(right)) < min_leaf:
            continue

        def gini(part):
            total = sum(w[r[-1]] for r in part)
            return total * (1 - sum((sum(w[c] for r in part if r[-1] == c) / total) ** 2 for c in (0, 1)))

        gain = gini(rows) - gini(left) - gini(right)
        if best is None or gain > best[0] + 1e-12:
            best = (gain, f, cut, left, right)
    if best:
        out[tree, node][:2] = [COLS[best[1]], best[2]]
        for child, part in ((2 * node, best[3]), (2 * node + 1, best[4])):
            grow(part, tree, child, depth + 1, max_depth, min_leaf, n_features, seed, w, out)


@pytest.mark.parametrize("max_depth,min_leaf,n_features", [(3, 5, 2), (6, 1, 1), (4, 20, 5), (0, 1, 2)])
def test_equals_recursive_growth(spark, max_depth, min_leaf, n_features):
    rows = some_rows()
    n1 = sum(r[-1] for r in rows)
    w = {0: len(rows) / (2 * (len(rows) - n1)), 1: len(rows) / (2 * n1)}
    want: dict = {}
    for t in range(5):
        grow(rows, t, 1, 0, max_depth, min_leaf, n_features, 9, w, want)
    model = fit_extra_trees(frame(spark, rows), 5, max_depth, min_leaf, COLS, n_features, seed=9)
    got = {(r.tree, r.node): r for r in model.nodes(spark).collect()}
    assert set(got) == set(want)
    for at, (feature, cut, n0, n1) in want.items():
        r = got[at]
        assert (r.feature, r.n0, r.n1) == (feature, n0, n1) and (cut is None or abs(r.cut - cut) < 1e-12), at
        assert abs(r.share - w[1] * n1 / (w[0] * n0 + w[1] * n1)) < 1e-12


def test_rows_order_and_partitions_do_not_matter(spark):
    rows = some_rows(200, 4)
    tables = []
    for parts in (1, 6):
        random.Random(parts).shuffle(rows)
        tables.append(sorted(map(repr, fit_extra_trees(frame(spark, rows, parts), 4, 5, 3, COLS).nodes(spark).collect())))
    assert tables[0] == tables[1]


def test_scores_are_mean_leaf_shares_and_importances_a_distribution(spark):
    rows = some_rows()
    df = frame(spark, rows)
    model = fit_extra_trees(df, 7, 4, 5, COLS)
    again = ExtraTrees.from_nodes(model.nodes(spark), COLS, model.weights)
    nodes = {(r.tree, r.node): r for r in model.nodes(spark).collect()}
    for r in again.transform(df).collect():
        total = 0.0
        for t in range(7):
            v = 1
            while (at := nodes[t, v]).feature:
                v = 2 * v + (r[at.feature] > at.cut)
            total += at.share
        assert r.score == pytest.approx(total / 7, abs=1e-12)
    imp = {r.feature: r.importance for r in model.importance_table(spark).collect()}
    assert sum(imp.values()) == pytest.approx(1) and imp["k"] == 0 and max(imp, key=imp.get) == "a"


def test_edges(spark):
    one = fit_extra_trees(frame(spark, [(1.0, 2.0, 3.0, 4.0, 5.0, 1)] * 30), 3, 4, 1, COLS)
    assert (one.feature < 0).all() and one.transform(frame(spark, some_rows(5))).agg(F.min("score"), F.max("score")).first() == (1.0, 1.0)
    same = fit_extra_trees(frame(spark, [(1.0, 2.0, 3.0, 4.0, 5.0, i % 2) for i in range(30)]), 3, 4, 1, COLS)
    assert (same.feature < 0).all() and same.importances().sum() == 0
    assert np.allclose(same.shares()[:, 1], 0.5)
    with pytest.raises(ValueError, match="labels"):
        fit_extra_trees(frame(spark, some_rows(5)).limit(0), 2, 2, 1, COLS)
    with pytest.raises(ValueError, match="max_depth"):
        fit_extra_trees(frame(spark, some_rows(5)), 2, 40, 1, COLS)
