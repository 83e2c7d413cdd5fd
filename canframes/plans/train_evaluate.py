"""Train and evaluate every classical detector on one leakage-safe split (the end-to-end
flow): clean -> content keys -> grouped split -> standardize -> fit each model on train
-> score test -> one long score table -> default-rule and best-F1 metrics per model,
plus the leakage audit (groups on both sides, test rows whose payload is in train).

The prepared, standardized table is checkpointed once and every fit reads it, several at a time; the long
score table of all models is checkpointed once and every report reads it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canframes.operators import metrics as M
from canframes.operators import newton
from canframes.operators import split as S
from canframes.operators.extra_trees import fit_extra_trees
from canframes.operators.irls import fit_irls, predict_proba
from canframes.operators.learners import fit_and_score
from canframes.operators.naive_bayes import BernoulliNB, ComplementNB, GaussianNB, Majority
from canframes.operators.neural import fit_mlp
from canframes.operators.online import decision_function, fit_online
from canframes.operators.scale import Standardizer, UniformBinner
from canframes.plans.fixtures import clean_view
from canframes.schema import FEATURES, SEED
from canframes.session import land

LEARNERS = {
    "logreg": "LogReg(balanced)",
    "logreg_l1": "LogReg-L1(balanced)",
    "svc": "LinearSVC(balanced)",
    "sgd_hinge": "Hinge(batch)",
    "ridge": "RidgeClassifier(balanced)",
    "tree": "DecisionTree(shallow)",
    "forest": "RandomForest(shallow)",
    "mlp": "MLP(resampled)",
}
PARALLEL_FITS = 6
BIN_COLS = [f"{c}_bin" for c in FEATURES]


def _at_once(spark: SparkSession, fits: list[Callable[[], DataFrame]]) -> list[DataFrame]:
    """The results of ``fits``, ``PARALLEL_FITS`` at a time: most of them are many short passes one
    after the other, which leave cores idle between them."""
    with ThreadPool(PARALLEL_FITS) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda fit: fit()), fits, chunksize=1)


def train_evaluate(spark: SparkSession, sf_dir: str, learners: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(metrics table with one row per model, leakage audit row) on the fixture frames."""
    return train_evaluate_frames(clean_view(spark, sf_dir), learners)


def train_evaluate_frames(frames: DataFrame, learners: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The same on any cleaned frame table (payload columns, label, frame_id, ID)."""
    learners = LEARNERS if learners is None else learners
    df = land(S.group_split(S.with_group_key(frames)), "split-frames", ["split"])
    train_raw = df.filter(F.col("split") == "train")
    std = Standardizer.fit(train_raw)
    z = land(std.transform(df), "scaled", ["split"])
    train, test = z.filter(F.col("split") == "train"), z.filter(F.col("split") == "test")
    cols = ["frame_id", "label", "score"]

    def balanced_mlp() -> DataFrame:
        inner = S.group_split(train.drop("split"), seed=SEED + 1)  # validation groups inside the training part
        return fit_mlp(inner.filter("split = 'train'"), inner.filter("split = 'test'")).transform(test)

    def binned_bayes(n_bins: int, cls) -> DataFrame:
        binned = UniformBinner.fit(train_raw, n_bins).transform(df)
        return cls.fit(binned.filter(F.col("split") == "train"), BIN_COLS).transform(binned.filter(F.col("split") == "test"))

    fits = [("Dummy(most_frequent)", lambda: Majority.fit(train).transform(test))]
    fits += [(name, partial(lambda key: fit_and_score(key, train, test)[1], key)) for key, name in learners.items()]
    if learners:
        fits.append(("ExtraTrees(shallow)", lambda: fit_extra_trees(train).transform(test)))
        fits.append(("MLP(balanced)", balanced_mlp))
        fits.append(("LinearSVC(squared hinge)", lambda: newton.decision_function(test, newton.fit_squared_hinge(train))))
        fits.append(("LogReg-L1(proximal Newton)", lambda: newton.predict_proba(test, newton.fit_l1_logistic(train))))
    fits.append(("LogReg(balanced, IRLS)", lambda: predict_proba(test, fit_irls(train))))
    online = [("perceptron", "Perceptron(balanced)"), ("pa", "PassiveAggressive(balanced)"), ("sgd_hinge", "SGD-hinge(balanced)")]
    fits += [(name, partial(lambda kind: decision_function(test, fit_online(train, kind=kind)), kind)) for kind, name in online]
    fits.append(("GaussianNB", lambda: GaussianNB.fit(train).transform(test)))
    fits.append(("ComplementNB(binned)", partial(binned_bayes, 16, ComplementNB)))
    fits.append(("BernoulliNB(binarized)", partial(binned_bayes, 2, BernoulliNB)))
    scored = _at_once(df.sparkSession, [fit for _, fit in fits])
    parts = [s.select(F.lit(name).alias("model"), *cols) for (name, _), s in zip(fits, scored, strict=True)]

    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    scores = land(scores, "model-scores")  # every report below reads the scores from here
    metrics = M.metrics_table(M.eval_with_thresholds(scores, thr=None))
    audit = S.leakage_audit(df)
    return M.round_doubles(metrics), audit
