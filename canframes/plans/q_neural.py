"""Queries: the class-weighted network with validation part and early stop."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from canframes.operators import metrics as M
from canframes.operators import neural as N
from canframes.operators.scale import Standardizer
from canframes.plans.catalog import register
from canframes.plans.q_split import prepared
from canframes.schema import FEATURES, SEED
from canframes.session import land


def _parts(spark, sf_dir):
    """Standardized frames in train, val and test by content key."""
    df = prepared(spark, sf_dir, val_size=0.2)
    z = land(Standardizer.fit(df.filter(F.col("split") == "train")).transform(df), "scaled", ["split"])
    return [z.filter(F.col("split") == s) for s in ("train", "val", "test")]


@register("mlp_weighted_metrics")
def q_mlp_weighted_metrics(spark, sf_dir):
    """128-64 network, balanced class weights, early stop on the validation groups; metrics row
    on the test split, threshold rows as for every probability model."""
    train, val, test = _parts(spark, sf_dir)
    model = N.fit_mlp(train, val)
    scored = model.transform(test).select(F.lit("MLP(weighted, early stop)").alias("model"), "frame_id", "label", "score")
    return M.round_doubles(M.metrics_table(M.eval_with_thresholds(scored, thr=None)))


@register("mlp_gradient_check", "SELECT CAST(k AS INT) AS direction, true AS slope_matches, true AS gradient_is_weighted FROM range(3) t(k)")
def q_mlp_gradient_check(spark, sf_dir):
    """Along drawn directions the summed gradient is the slope of the summed loss, and equal
    total class weights make the mean loss of the classes count alike."""
    train, val, _ = _parts(spark, sf_dir)
    sizes = N.shapes(len(FEATURES), (16, 8))
    rows = N.training_rows(train, val, FEATURES)
    theta = N.start(sizes, SEED)
    loss, g, _ = N.epoch(rows, FEATURES, theta, sizes)
    per_class = N.MLP(FEATURES, sizes, theta).transform(train).groupBy("label").agg(F.avg(F.when(F.col("label") == 1, -F.log("score")).otherwise(-F.log(1 - F.col("score")))).alias("l"))
    alike = abs(per_class.agg(F.avg("l")).first()[0] - loss) < 1e-9
    rng, out, h = np.random.default_rng(SEED), [], 1e-5
    for k in range(3):
        d = rng.normal(size=len(theta))
        d /= np.linalg.norm(d)
        slope = (N.epoch(rows, FEATURES, theta + h * d, sizes)[0] - N.epoch(rows, FEATURES, theta - h * d, sizes)[0]) / (2 * h)
        out.append((k, bool(abs(slope - g @ d) <= 1e-5 * max(1.0, abs(slope))), bool(alike)))
    return spark.createDataFrame(out, "direction int, slope_matches boolean, gradient_is_weighted boolean")


@register("mlp_early_stop", "SELECT true AS best_is_kept, true AS training_loss_falls, true AS within_budget, true AS stopped_in_time")
def q_mlp_early_stop(spark, sf_dir):
    """The kept parameters have the least validation loss of the trace (measured again from the
    scores), the training loss falls with every accepted step, and no more than ``patience``
    steps follow the best one."""
    train, val, _ = _parts(spark, sf_dir)
    model = N.fit_mlp(train, val, hidden=(16, 8), epochs=30, patience=2)
    p = F.col("score")
    again = model.transform(val).agg(F.avg(F.when(F.col("label") == 1, -F.log(p)).otherwise(-F.log(1 - p)))).first()[0]
    losses, held = zip(*model.trace, strict=True)
    got = (
        bool(abs(again - min(held)) < 1e-9), all(b <= a for a, b in zip(losses, losses[1:])), model.epochs <= 30,
        len(held) - 1 - model.best <= 2 and (model.stopped != "patience" or len(held) - 1 - model.best == 2),
    )
    return spark.createDataFrame([got], "best_is_kept boolean, training_loss_falls boolean, within_budget boolean, stopped_in_time boolean")
