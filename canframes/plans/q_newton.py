"""Queries: linear learners fitted by Newton rounds, checked by optimality. The oracle knows
the optimum of each objective only as the point where the (sub)gradient vanishes, so the
query recomputes the gradient from the rows at the fitted parameters, apart from the fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from canframes.operators import metrics as M
from canframes.operators import newton
from canframes.operators.split import class_weights, with_class_weight
from canframes.plans.catalog import register
from canframes.plans.q_scale import standardized
from canframes.schema import FEATURES

FITS = {
    "svc_squared_hinge": ("LinearSVC(squared hinge)", newton.fit_squared_hinge),
    "logreg_l1_newton": ("LogReg-L1(proximal Newton)", newton.fit_l1_logistic),
}


def _fitted(spark, sf_dir, key):
    z, _ = standardized(spark, sf_dir)
    return z, FITS[key][1](z.filter(F.col("split") == "train"))


def _scored(z, key, fit):
    test = z.filter(F.col("split") == "test")
    return newton.predict_proba(test, fit) if key.startswith("logreg") else newton.decision_function(test, fit)


def _metrics(spark, sf_dir, key):
    z, fit = _fitted(spark, sf_dir, key)
    scored = _scored(z, key, fit).select(F.lit(FITS[key][0]).alias("model"), "frame_id", "label", "score")
    return M.round_doubles(M.metrics_table(M.eval_with_thresholds(scored, thr=None)))


@register("svc_squared_hinge_metrics")
def q_svc_squared_hinge_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir, "svc_squared_hinge")


@register("logreg_l1_newton_metrics")
def q_logreg_l1_newton_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir, "logreg_l1_newton")


@register(
    "newton_optimality",
    "SELECT m.model, f.feature, true AS optimal, true AS converged FROM (VALUES "
    + ", ".join(f"('{k}')" for k in FITS)
    + ") m(model), (VALUES "
    + ", ".join(f"('{c}')" for c in [*FEATURES, "intercept"])
    + ") f(feature)",
)
def q_newton_optimality(spark, sf_dir):
    """Zero gradient (squared hinge) or zero in the subgradient (L1 logistic) in every weight
    and the penalized intercept."""
    rows = []
    for key in FITS:
        z, fit = _fitted(spark, sf_dir, key)
        train = z.filter(F.col("split") == "train")
        train = with_class_weight(train, class_weights(train))
        y, m = F.col("label") * 2.0 - 1.0, fit.margin()
        slope = -y / (1.0 + F.exp(y * m)) if key.startswith("logreg") else F.when(y * m < 1, 2.0 * (m - y)).otherwise(0.0)
        sums = [F.sum(F.col("weight") * slope * F.col(c)).alias(c) for c in FEATURES] + [F.sum(F.col("weight") * slope).alias("intercept")]
        got = train.agg(*sums, F.sum("weight").alias("n")).first()
        for c, b in zip([*FEATURES, "intercept"], fit.beta.tolist(), strict=True):
            if key.startswith("logreg"):
                off = abs(got[c] + (1 if b > 0 else -1)) if b else max(0.0, abs(got[c]) - 1)
            else:
                off = abs(got[c] + b)
            rows.append((key, c, off / got["n"] < 1e-7, fit.converged))
    return spark.createDataFrame(rows, "model string, feature string, optimal boolean, converged boolean")
