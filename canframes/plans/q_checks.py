"""Queries that state properties a result must have, so that SQL can check operators whose
fitted numbers it cannot recompute: optimality of the linear learners at their fitted
parameters, leaf probabilities of the tree, the importance table, attached class weights,
and positions by text times."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canframes.operators import learners as L
from canframes.operators import sequence as Q
from canframes.operators.split import class_weights, with_class_weight
from canframes.plans.catalog import register
from canframes.plans.fixtures import clean_view, oracle
from canframes.plans.q_models import learner_scores, standardized
from canframes.plans.q_split import prepared
from canframes.schema import FEATURES
from canframes.session import land

_TEXT_TIME = "CASE WHEN frame_id % 7 = 0 THEN NULL ELSE CAST(frame_id * 37 % 400 AS VARCHAR) END"


@register(
    "text_time_positions",
    oracle(
        "SELECT frame_id, ID, row_number() OVER (PARTITION BY ID ORDER BY CAST(t AS DOUBLE) NULLS LAST, frame_id) - 1 AS pos,"
        " count(*) OVER (PARTITION BY ID) AS n_in_id FROM tt",
        ["clean"],
        [("tt", f"SELECT frame_id, ID, {_TEXT_TIME} AS t FROM clean")],
    ),
)
def q_text_time_positions(spark, sf_dir):
    """Times as text (many ties, some missing) sort by value, missing ones last."""
    text = F.when(F.col("frame_id") % 7 != 0, (F.col("frame_id") * 37 % 400).cast("string"))
    return Q.positions(clean_view(spark, sf_dir).withColumn("ts", text)).select("frame_id", "ID", "pos", "n_in_id")


@register(
    "weighted_rows",
    oracle(
        "SELECT frame_id, label, round(CAST(sum(1) OVER () AS DOUBLE) / (2 * count(*) OVER (PARTITION BY label)), 9) AS weight"
        " FROM prepared WHERE split = 'train'",
        ["prepared"],
    ),
)
def q_weighted_rows(spark, sf_dir):
    """Training rows with their balanced class weight attached."""
    train = prepared(spark, sf_dir).filter("split = 'train'")
    return with_class_weight(train, class_weights(train)).select("frame_id", "label", F.round("weight", 9).alias("weight"))


def _gradient(rows: DataFrame, slope: Column, total: float) -> dict[str, float]:
    """Mean weighted derivative of the loss in each coefficient and the intercept."""
    parts = [F.sum(F.col("weight") * slope * F.col(c)).alias(c) for c in FEATURES] + [F.sum(F.col("weight") * slope).alias("intercept")]
    return {k: v / total for k, v in rows.agg(*parts).first().asDict().items()}


def _margin(model) -> Column:
    terms = [F.lit(float(b)) * F.col(c) for b, c in zip(model.coefficients.toArray(), FEATURES)]
    return reduce(lambda a, b: a + b, terms, F.lit(float(model.intercept)))


def _optimal(gradient: dict[str, float], model, l2: float, l1: float, tolerance: float = 2e-4) -> list[tuple[str, bool]]:
    """Zero (sub)gradient of loss + l2/2 |b|^2 + l1 |b| in every coefficient; the intercept
    is not penalized."""
    out = [("intercept", abs(gradient["intercept"]) <= tolerance)]
    for c, b in zip(FEATURES, model.coefficients.toArray()):
        g = gradient[c] + l2 * float(b)
        out.append((c, abs(g + l1 * (1 if b > 0 else -1)) <= tolerance if b else abs(g) <= l1 + tolerance))
    return out


_ALL_OPTIMAL = (
    "SELECT m.model, f.feature, true AS optimal FROM (VALUES ('logreg'), ('logreg_l1'), ('ridge')) m(model), (VALUES "
    + ", ".join(f"('{c}')" for c in [*FEATURES, "intercept"])
    + ") f(feature)"
)


@register("linear_optimality", _ALL_OPTIMAL)
def q_linear_optimality(spark, sf_dir):
    """The data-side (sub)gradient of each linear objective vanishes at the fitted parameters."""
    z, _ = standardized(spark, sf_dir)
    train, w = L.weighted(z.filter("split = 'train'"))
    train = land(train, "weighted-train")
    y = F.col("label").cast("double")
    rows = []
    for name in ("logreg", "logreg_l1", "ridge"):
        model, _ = L.fit_and_score(name, train.drop("weight"), train.drop("weight"))
        m = _margin(model)
        slope = m - (2 * y - 1) if name == "ridge" else 1 / (1 + F.exp(-m)) - y
        penalty = {"logreg": (1 / w, 0.0), "logreg_l1": (0.0, 1 / w), "ridge": (1 / w, 0.0)}[name]
        rows += [(name, c, ok) for c, ok in _optimal(_gradient(train, slope, w), model, *penalty)]
    return spark.createDataFrame(rows, "model string, feature string, optimal boolean")


@register("tree_leaf_shares", "SELECT 0 AS n_wrong_leaves, true AS has_leaves")
def q_tree_leaf_shares(spark, sf_dir):
    """The probability of every leaf of the tree is the weighted share of attack frames in it."""
    z, _ = standardized(spark, sf_dir)
    train = z.filter("split = 'train'")
    model, _ = L.fit_and_score("tree", train, train)
    rows, _ = L.weighted(L.assemble(train))
    leaves = model.setLeafCol("leaf").transform(rows).groupBy("leaf").agg(
        (F.sum(F.col("weight") * F.col("label")) / F.sum("weight")).alias("share"),
        F.min(vector_to_array("probability")[1]).alias("lo"), F.max(vector_to_array("probability")[1]).alias("hi"),
    )
    wrong = F.count_if((F.abs(F.col("lo") - F.col("share")) > 1e-9) | (F.abs(F.col("hi") - F.col("share")) > 1e-9))
    return leaves.agg(wrong.cast("int").alias("n_wrong_leaves"), (F.count("*") > 1).alias("has_leaves"))


@register("importance_check", f"SELECT CAST(1.0 AS DOUBLE) AS total, 0 AS n_negative, {len(FEATURES)} AS n_features, true AS ranked")
def q_importance_check(spark, sf_dir):
    """Forest importances are a ranked distribution over the features."""
    model, _ = learner_scores(spark, sf_dir, "forest")
    rows = [r.importance for r in L.importance_table(model, spark=spark).collect()]  # one row per feature
    got = (round(sum(rows), 6), sum(x < 0 for x in rows), len(rows), rows == sorted(rows, reverse=True))
    return spark.createDataFrame([got], "total double, n_negative int, n_features int, ranked boolean")


@register(
    "coefficient_ranks",
    "SELECT CAST(r AS INT) AS abs_rank, true AS in_order FROM range(1, " + str(len(FEATURES) + 1) + ") t(r)",
)
def q_coefficient_ranks(spark, sf_dir):
    """Coefficients of the logistic model ranked by magnitude: each rank once, none larger
    than the one before."""
    model, _ = learner_scores(spark, sf_dir, "logreg")
    rows = sorted((r.abs_rank, abs(r.coef)) for r in L.coefficient_table(model, spark=spark).collect())
    got = [(k, i == 0 or c <= rows[i - 1][1]) for i, (k, c) in enumerate(rows)]
    return spark.createDataFrame(got, "abs_rank int, in_order boolean")
