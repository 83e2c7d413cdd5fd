"""Classical learners on ``pyspark.ml``: fit on the training split with balanced class
weights, score the test split, return a long score table ``(model, frame_id, label, score)``
for the metrics operators.

Objective mapping (C = 1, W = sum of training weights): a loss of the form
``C * sum(w * loss) + 0.5 * |beta|^2`` equals Spark's ``(1/W) * sum(w * loss) +
regParam/2 * |beta|^2`` with ``regParam = 1 / (C * W)``. Known deviations: Spark does
not penalize the intercept, LinearSVC uses hinge (not squared hinge; ``newton`` has that),
the forest uses best splits over 256 bins (``extra_trees`` draws random cuts), and the MLP
has no sample weights (``neural`` has; here the training set is balanced by resampling, its
copies being weights of ``sigmoid_net``).
"""

from __future__ import annotations

from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canframes.functions.hashing import shuffle_key
from canframes.operators import sigmoid_net
from canframes.operators.split import class_weights, with_class_weight
from canframes.schema import (
    FEATURES,
    FOREST_MAX_DEPTH,
    FOREST_MIN_LEAF,
    FOREST_TREES,
    LINEAR_SVC_MAX_ITER,
    LOGREG_C,
    LOGREG_L1_MAX_ITER,
    MLP_HIDDEN,
    SEED,
    SGD_ALPHA,
    SGD_MAX_ITER,
    SGD_TOL,
    TREE_MAX_DEPTH,
    TREE_MIN_LEAF,
)
from canframes.session import land

VEC = "features"


def assemble(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    return VectorAssembler(inputCols=features or FEATURES, outputCol=VEC, handleInvalid="keep").transform(df)


def weighted(train: DataFrame) -> tuple[DataFrame, float]:
    """Attach balanced weights; return the weighted table and the weight total W."""
    w = class_weights(train)
    tw = with_class_weight(train, w)
    total = float(w.agg(F.sum(F.col("n") * F.col("weight"))).first()[0])  # = number of training rows
    return tw, total


def score_column(pred: DataFrame, kind: str | None = None) -> DataFrame:
    """Probability of class 1 when the model has one, else the margin, else the prediction;
    ``kind`` (``probability``, ``raw``, ``prediction``) overrides what the columns say."""
    if kind is None:
        kind = "probability" if "probability" in pred.columns else "raw" if "rawPrediction" in pred.columns else "prediction"
    if kind == "probability":
        return pred.withColumn("score", vector_to_array("probability")[1])
    if kind == "raw":
        return pred.withColumn("score", vector_to_array("rawPrediction")[1])
    return pred.withColumn("score", F.col("prediction").cast("double"))


def resample_copies(counts: dict, label: str = "label", seed: int = SEED) -> Column:
    """How often a row enters the class-balanced training set, given the rows of each class: once
    in the largest class, else floor(ratio) times plus a seeded hash-chosen remainder."""
    if len(counts) < 2:
        return F.lit(1)
    big = max(counts, key=counts.get)
    h8 = F.conv(F.substring(shuffle_key("frame_id", seed), 1, 8), 16, 10).cast("double") / float(16**8)
    copies = F.when(F.col(label) == F.lit(big), 1)
    for lab, n in counts.items():
        if lab != big:
            ratio = counts[big] / n
            copies = copies.when(F.col(label) == F.lit(lab), int(ratio) + (h8 < ratio - int(ratio)).cast("int"))
    return copies


def class_rows(train: DataFrame, label: str = "label") -> dict:
    return {r[0]: r[1] for r in train.groupBy(label).count().collect()}  # one row per class


def balanced_resample(train: DataFrame, seed: int = SEED) -> DataFrame:
    """Class balance without weights: every row as often as :func:`resample_copies` says."""
    copies = resample_copies(class_rows(train), "label", seed)
    return train.withColumn("_r", F.explode(F.array_repeat(F.lit(1), copies))).drop("_r")


def fit_resampled_mlp(train: DataFrame, features: list[str], seed: int = SEED, max_iter: int = 50):
    """The network on the class-balanced training rows, landed once with their numbers of copies."""
    spark = train.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = train.select("frame_id", F.col("label").cast("int").alias("label"), *[F.col(c).cast("double").alias(c) for c in features])
    rows = land(rows.repartition(parts, "frame_id"), "mlp-rows")
    rows = rows.select("label", *features, resample_copies(class_rows(rows), "label", seed).alias("copies"))
    blocks = sigmoid_net.packed(rows, sigmoid_net.column_reader(features))
    return sigmoid_net.fit(blocks, tuple, [len(features), *MLP_HIDDEN, 2], max_iter, seed)


def fit_and_score(name: str, train: DataFrame, test: DataFrame, features: list[str] | None = None, seed: int = SEED):
    """Fit one named learner and return (model, scored test rows)."""
    features = features or FEATURES
    tr = assemble(train, features)
    te = assemble(test, features)
    if name in ("logreg", "logreg_l1", "svc", "sgd_hinge", "ridge", "tree", "forest"):
        tr, W = weighted(tr)
    if name == "logreg":
        m = LogisticRegression(featuresCol=VEC, weightCol="weight", regParam=1.0 / (LOGREG_C * W), standardization=False, maxIter=100, tol=1e-8).fit(tr)
        kind = "probability"
    elif name == "logreg_l1":
        m = LogisticRegression(featuresCol=VEC, weightCol="weight", regParam=1.0 / (LOGREG_C * W), elasticNetParam=1.0, standardization=False, maxIter=LOGREG_L1_MAX_ITER).fit(tr)
        kind = "probability"
    elif name == "svc":
        m = LinearSVC(featuresCol=VEC, weightCol="weight", regParam=1.0 / W, standardization=False, maxIter=LINEAR_SVC_MAX_ITER).fit(tr)
        kind = "raw"
    elif name == "sgd_hinge":
        m = LinearSVC(featuresCol=VEC, weightCol="weight", regParam=SGD_ALPHA, standardization=False, maxIter=SGD_MAX_ITER, tol=SGD_TOL).fit(tr)
        kind = "raw"
    elif name == "ridge":
        tr = tr.withColumn("_y", F.col("label") * 2.0 - 1.0)
        m = LinearRegression(featuresCol=VEC, labelCol="_y", weightCol="weight", regParam=1.0 / W, solver="normal", standardization=False).fit(tr)
        kind = "prediction"
    elif name == "tree":
        m = DecisionTreeClassifier(featuresCol=VEC, weightCol="weight", maxDepth=TREE_MAX_DEPTH, minInstancesPerNode=TREE_MIN_LEAF, maxBins=256, seed=seed).fit(tr)
        kind = "probability"
    elif name == "forest":
        m = RandomForestClassifier(
            featuresCol=VEC, weightCol="weight", numTrees=FOREST_TREES, maxDepth=FOREST_MAX_DEPTH, minInstancesPerNode=FOREST_MIN_LEAF,
            featureSubsetStrategy="sqrt", bootstrap=False, maxBins=256, seed=seed,
        ).fit(tr)
        kind = "probability"
    elif name == "mlp":
        m = fit_resampled_mlp(train, features, seed)
        kind = "probability"
    else:
        raise KeyError(name)
    pred = m.transform(te)
    return m, score_column(pred, kind)


def coefficient_table(model, features: list[str] | None = None, spark=None) -> DataFrame:
    """(feature, coef, abs_rank): linear coefficients ranked by magnitude (<= a few dozen rows)."""
    features = features or FEATURES
    coefs = [float(v) for v in model.coefficients.toArray()]
    df = spark.createDataFrame(list(zip(features, coefs)), "feature string, coef double")
    return df.withColumn("abs_rank", F.row_number().over(Window.orderBy(F.abs("coef").desc(), "feature")))


def importance_table(model, features: list[str] | None = None, spark=None) -> DataFrame:
    """(feature, importance) sorted descending."""
    features = features or FEATURES
    imp = [float(v) for v in model.featureImportances.toArray()]
    return spark.createDataFrame(list(zip(features, imp)), "feature string, importance double").orderBy(F.desc("importance"), "feature")
