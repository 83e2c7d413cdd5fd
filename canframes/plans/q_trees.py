"""Queries: extremely randomized trees. The oracle grows the same trees in SQL, level by
level, from the same digests; scores and importances follow from its node table."""

from __future__ import annotations

from pyspark.sql import functions as F

from canframes.operators import metrics as M
from canframes.operators.extra_trees import fit_extra_trees
from canframes.plans.catalog import register
from canframes.plans.fixtures import oracle
from canframes.plans.q_scale import standardized
from canframes.plans.q_split import prepared
from canframes.schema import FEATURES, SEED

# the trees that SQL grows as well: on the raw payload, whose values are the same in both engines
TREES, DEPTH, MIN_LEAF, CUTS = 6, 4, 10, 2


def _draw(use: str) -> str:
    return f"md5('{SEED}:' || tree || ':' || node || ':' || fi || ':{use}')"


def _squares(a0: str, a1: str) -> str:
    return f"(({a0}) * w0 * (({a0}) * w0) + ({a1}) * w1 * (({a1}) * w1)) / (({a0}) * w0 + ({a1}) * w1)"


_GAIN = f"{_squares('l0', 'l1')} + {_squares('r0', 'r1')} - {_squares('l0 + r0', 'l1 + r1')}"


def _unpivoted(src: str) -> str:
    return " UNION ALL ".join(f"SELECT frame_id, {i} AS fi, CAST({c} AS DOUBLE) AS v FROM {src}" for i, c in enumerate(FEATURES))


def _grown() -> list[tuple[str, str]]:
    """CTEs up to ``nodes`` (tree, node, fi, cut, n0, n1) and ``cw`` (class weights)."""
    ctes = [
        ("tr", "SELECT * FROM prepared WHERE split = 'train'"),
        ("cw", "SELECT count(*) / (2.0 * sum(1 - label)) AS w0, count(*) / (2.0 * sum(label)) AS w1 FROM tr"),
        ("x", _unpivoted("tr")),
        ("r0", f"SELECT CAST(t.tree AS INT) AS tree, 1 AS node, frame_id, label FROM tr, range({TREES}) t(tree)"),
    ]
    parts = []
    for k in range(DEPTH + 1):
        ctes.append((f"c{k}", f"SELECT tree, node, CAST(sum(1 - label) AS BIGINT) AS n0, CAST(sum(label) AS BIGINT) AS n1 FROM r{k} GROUP BY tree, node"))
        if k == DEPTH:
            parts.append(f"SELECT tree, node, CAST(NULL AS INT) AS fi, CAST(NULL AS DOUBLE) AS cut, n0, n1 FROM c{k}")
            break
        ctes += [
            (
                f"b{k}",
                f"SELECT r.tree, r.node, x.fi, min(v) AS lo, max(v) AS hi FROM r{k} r JOIN c{k} USING (tree, node) JOIN x USING (frame_id)"
                f" WHERE n0 > 0 AND n1 > 0 AND n0 + n1 >= {2 * MIN_LEAF} GROUP BY r.tree, r.node, x.fi",
            ),
            (
                f"k{k}",
                f"SELECT tree, node, fi, CASE WHEN spot < hi THEN spot ELSE lo END AS cut, k FROM (SELECT *, lo + CAST('0x' || substr({_draw('cut')}, 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE * (hi - lo) AS spot,"
                f" row_number() OVER (PARTITION BY tree, node ORDER BY {_draw('order')}) AS k FROM b{k} WHERE hi > lo) d WHERE k <= {CUTS}",
            ),
            (
                f"s{k}",
                "SELECT r.tree, r.node, q.fi, q.cut, q.k, "
                + ", ".join(f"count(*) FILTER (WHERE v {op} q.cut AND label = {c}) AS {side}{c}" for side, op in (("l", "<="), ("r", ">")) for c in (0, 1))
                + f" FROM r{k} r JOIN k{k} q USING (tree, node) JOIN x ON x.frame_id = r.frame_id AND x.fi = q.fi GROUP BY r.tree, r.node, q.fi, q.cut, q.k",
            ),
            (
                f"g{k}",
                f"SELECT tree, node, fi, cut FROM (SELECT *, row_number() OVER (PARTITION BY tree, node ORDER BY {_GAIN} DESC, k) AS best FROM s{k}, cw"
                f" WHERE l0 + l1 >= {MIN_LEAF} AND r0 + r1 >= {MIN_LEAF}) b WHERE best = 1",
            ),
            (
                f"r{k + 1}",
                f"SELECT r.tree, 2 * r.node + CASE WHEN v > g.cut THEN 1 ELSE 0 END AS node, r.frame_id, r.label"
                f" FROM r{k} r JOIN g{k} g USING (tree, node) JOIN x ON x.frame_id = r.frame_id AND x.fi = g.fi",
            ),
        ]
        parts.append(f"SELECT c.tree, c.node, g.fi, g.cut, c.n0, c.n1 FROM c{k} c LEFT JOIN g{k} g USING (tree, node)")
    return [*ctes, ("nodes", " UNION ALL ".join(parts))]


def _grown_oracle(select: str, ctes: list[tuple[str, str]] = ()) -> str:
    return oracle("", ["prepared"]) + "".join(f", {n} AS MATERIALIZED ({s})\n" for n, s in [*_grown(), *ctes]) + select


_NAME = "CASE fi " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(FEATURES)) + " END"
_SHARE = "n1 * w1 / (n0 * w0 + n1 * w1)"


def _small_trees(spark, sf_dir):
    df = prepared(spark, sf_dir)
    return df, fit_extra_trees(df.filter("split = 'train'"), TREES, DEPTH, MIN_LEAF, n_features=CUTS)


@register(
    "extra_trees_nodes",
    _grown_oracle(f"SELECT tree, node, {_NAME} AS feature, round(cut, 9) AS cut, n0, n1, round({_SHARE}, 9) AS share FROM nodes, cw"),
)
def q_extra_trees_nodes(spark, sf_dir):
    """The node table of the trees: cuts, class counts, weighted leaf shares."""
    _, model = _small_trees(spark, sf_dir)
    return M.round_doubles(model.nodes(spark), 9)


def _routed() -> list[tuple[str, str]]:
    ctes = [
        ("te", "SELECT * FROM prepared WHERE split = 'test'"),
        ("xe", _unpivoted("te")),
        ("e0", f"SELECT CAST(t.tree AS INT) AS tree, 1 AS node, frame_id, label FROM te, range({TREES}) t(tree)"),
    ]
    for k in range(DEPTH):
        ctes.append(
            (
                f"e{k + 1}",
                "SELECT e.tree, CASE WHEN n.fi IS NULL THEN e.node WHEN v > n.cut THEN 2 * e.node + 1 ELSE 2 * e.node END AS node, e.frame_id, e.label"
                f" FROM e{k} e JOIN nodes n ON n.tree = e.tree AND n.node = e.node LEFT JOIN xe ON xe.frame_id = e.frame_id AND xe.fi = n.fi",
            )
        )
    return ctes


@register(
    "extra_trees_scores",
    _grown_oracle(f"SELECT frame_id, label, round(avg({_SHARE}), 9) AS score FROM e{DEPTH} e JOIN nodes n USING (tree, node), cw GROUP BY frame_id, label", _routed()),
)
def q_extra_trees_scores(spark, sf_dir):
    """Mean leaf share over the trees for every test frame, from the stored node table."""
    from canframes.operators.extra_trees import ExtraTrees
    from canframes.session import land

    df, model = _small_trees(spark, sf_dir)
    stored = ExtraTrees.from_nodes(land(model.nodes(spark), "tree-nodes"), model.features, model.weights)
    return M.round_doubles(stored.transform(df.filter("split = 'test'")).select("frame_id", "label", "score"), 9)


_IMPORTANCE = [
    (
        "fall",
        "SELECT p.tree, p.fi, " + _GAIN.replace("l0", "l.n0").replace("l1", "l.n1").replace("r0", "r.n0").replace("r1", "r.n1")
        + " AS gain FROM nodes p JOIN nodes l ON l.tree = p.tree AND l.node = 2 * p.node JOIN nodes r ON r.tree = p.tree AND r.node = 2 * p.node + 1, cw",
    ),
    ("per_tree", "SELECT fi, gain / sum(gain) OVER (PARTITION BY tree) AS part FROM fall"),
]


@register(
    "extra_trees_importances",
    _grown_oracle(
        f"SELECT {_NAME} AS feature, round(coalesce(sum(part), 0) / (SELECT sum(part) FROM per_tree), 9) AS importance"
        f" FROM range({len(FEATURES)}) f(fi) LEFT JOIN per_tree USING (fi) GROUP BY fi",
        _IMPORTANCE,
    ),
)
def q_extra_trees_importances(spark, sf_dir):
    """Impurity decrease by feature, each tree's shares averaged."""
    _, model = _small_trees(spark, sf_dir)
    return M.round_doubles(model.importance_table(spark), 9)


@register("extra_trees_metrics")
def q_extra_trees_metrics(spark, sf_dir):
    """The full forest (64 trees, depth 8) on standardized frames; metrics row on the test split."""
    z, _ = standardized(spark, sf_dir)
    model = fit_extra_trees(z.filter(F.col("split") == "train"))
    scored = model.transform(z.filter(F.col("split") == "test")).select(F.lit("ExtraTrees(random cuts)").alias("model"), "frame_id", "label", "score")
    return M.round_doubles(M.metrics_table(M.eval_with_thresholds(scored, thr=None)))
