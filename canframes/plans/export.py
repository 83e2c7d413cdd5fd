"""Artifact export and batch scoring with stored artifacts.

``export_artifacts`` fits the three export models (balanced logistic regression,
Gaussian NB, 100 extremely randomized trees) on the training split, evaluates them on the test split
and writes: metrics table, thresholds JSON, metadata JSON (features, thresholds, split
sizes), tree importances, logistic coefficients, scaler / linear / NB parameter tables,
the tree node table with its class weights, the ``pyspark.ml`` model directory and the whole
logistic scoring path as one saved pipeline (scaling, assembling, model). ``score_with_artifacts`` loads them back
and scores frames at the stored thresholds.

Thresholds are tuned on a validation split by default (``tune_on="val"``); pass
``tune_on="test"`` to tune on the evaluation split itself.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canframes.operators import metrics as M
from canframes.operators.extra_trees import ExtraTrees, fit_extra_trees
from canframes.operators.learners import VEC, assemble, coefficient_table, fit_and_score, score_column
from canframes.operators.naive_bayes import GaussianNB, gnb_params
from canframes.operators.scale import Standardizer, scaler_params
from canframes.operators import split as S
from canframes.plans.fixtures import clean_view
from canframes.plans.q_split import prepared
from canframes.schema import EXPORT_FOREST_MIN_LEAF, EXPORT_FOREST_TREES, FEATURES, SEED, TEST_SIZE
from canframes.session import land
from canframes.sources import sinks

MODELS = [("logreg", "LogReg(balanced)"), ("gnb", "GaussianNB"), ("extratrees", "ExtraTrees(d=8,100)")]
LABELS = dict(MODELS)


def export_artifacts(spark: SparkSession, sf_dir: str, out_dir: str, tune_on: str = "val", seed: int = SEED) -> DataFrame:
    """Export over the fixture frames of ``sf_dir``."""
    return export_artifacts_frames(clean_view(spark, sf_dir), out_dir, tune_on, seed)


def export_artifacts_frames(frames: DataFrame, out_dir: str, tune_on: str = "val", seed: int = SEED) -> DataFrame:
    """Export over any cleaned frame table (payload, label, frame_id, ID)."""
    spark = frames.sparkSession
    df = S.group_split(S.with_group_key(frames), val_size=TEST_SIZE if tune_on == "val" else None)
    train = df.filter(F.col("split") == "train")
    std = Standardizer.fit(train)
    z = land(std.transform(df), "scaled", ["split"])  # read by three fits and three scorings
    ztrain = z.filter(F.col("split") == "train")

    logreg, lr_scored = fit_and_score("logreg", ztrain, z, seed=seed)
    trees = fit_extra_trees(ztrain, EXPORT_FOREST_TREES, min_leaf=EXPORT_FOREST_MIN_LEAF, seed=seed)
    trees_scored = trees.transform(z)
    gnb = GaussianNB.fit(ztrain)
    gnb_scored = gnb.transform(z)
    cols = ["model", "key", "frame_id", "label", "score", "split"]
    long = (
        lr_scored.select(F.lit(LABELS["logreg"]).alias("model"), F.lit("logreg").alias("key"), "frame_id", "label", "score", "split")
        .unionByName(gnb_scored.select(F.lit(LABELS["gnb"]).alias("model"), F.lit("gnb").alias("key"), *cols[2:]))
        .unionByName(trees_scored.select(F.lit(LABELS["extratrees"]).alias("model"), F.lit("extratrees").alias("key"), *cols[2:]))
    )
    long = land(long, "model-scores")  # model scores once; every report reads them from here
    test = long.filter(F.col("split") == "test")
    tune = long.filter(F.col("split") == tune_on) if tune_on != "test" else None
    evaluated = M.eval_with_thresholds(test.drop("key"), thr=0.5, tune=None if tune is None else tune.drop("key"))
    keys = long.select("model", "key").distinct()
    evaluated = evaluated.join(F.broadcast(keys), "model")  # one row per model

    metrics = M.metrics_table(evaluated)
    sinks.write_metrics(metrics, f"{out_dir}/metrics.csv")
    notes = f"Thresholds computed on the {tune_on} split; reuse as fixed thresholds for scoring."
    sinks.write_json_row(sinks.thresholds_frame(evaluated, notes), f"{out_dir}/thresholds.json")
    split_sizes = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    meta = evaluated.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.col("key"), F.lit(f"_{tune_on}_f1_best")), "thr_bestF1"))).alias("thresholds"))
    splits = split_sizes.agg(F.map_from_entries(F.collect_list(F.struct("split", "n")))).scalar()  # one row per split
    meta = meta.select(F.array(*[F.lit(f) for f in FEATURES]).alias("features"), "thresholds", splits.alias("splits"), F.lit(notes).alias("notes"))
    sinks.write_json_row(meta, f"{out_dir}/meta.json")
    sinks.write_importances(trees.importance_table(spark), f"{out_dir}/extratrees_feature_importances.csv")
    sinks.write_coefficients(coefficient_table(logreg, spark=spark), f"{out_dir}/logreg_coefficients.csv")
    sinks.write_params(scaler_params(train), f"{out_dir}/scaler")
    lin = spark.createDataFrame(
        [(f, float(w)) for f, w in zip(FEATURES, logreg.coefficients.toArray())] + [("__intercept__", float(logreg.intercept))],
        "feature string, value double",
    )
    sinks.write_params(lin, f"{out_dir}/logreg_params")
    sinks.write_params(gnb_params(ztrain), f"{out_dir}/gnb_params")
    sinks.save_model(logreg, f"{out_dir}/logreg_model")
    sinks.save_model(scoring_pipeline(std, logreg), f"{out_dir}/scoring_pipeline")
    sinks.write_params(trees.nodes(spark), f"{out_dir}/extratrees_nodes")
    sinks.write_params(spark.createDataFrame(list(enumerate(trees.weights)), "label int, weight double"), f"{out_dir}/extratrees_weights")
    return spark.read.option("header", True).option("inferSchema", True).csv(f"{out_dir}/metrics.csv")


def scoring_pipeline(std: Standardizer, model) -> PipelineModel:
    """Scaling, assembling and a fitted linear model as one pipeline for cleaned frames."""
    scaled = ", ".join(f"(CAST({c} AS DOUBLE) - ({std.mean[c]!r}D)) / {std.scale[c]!r}D AS z_{c}" for c in FEATURES)
    stages = [
        SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"z_{c}" for c in FEATURES], outputCol=VEC, handleInvalid="keep"),
        model,
    ]
    return PipelineModel(stages)


def load_gnb(spark: SparkSession, path: str) -> GaussianNB:
    rows = spark.read.parquet(path).collect()  # classes x features rows
    prior, mean, var = {}, {}, {}
    for r in rows:
        prior[r.label] = r.prior
        mean.setdefault(r.label, {})[r.feature] = r.mean
        var.setdefault(r.label, {})[r.feature] = r.var
    return GaussianNB(prior, mean, var)


def score_with_artifacts(spark: SparkSession, sf_dir: str, art_dir: str, split: str = "test") -> DataFrame:
    """Long table (model, frame_id, label, score, thr, pred) from the stored artifacts,
    for the given split of the fixture frames."""
    frames = prepared(spark, sf_dir).filter(F.col("split") == split)
    return score_frames_with_artifacts(frames, art_dir)


def score_frames_with_artifacts(frames: DataFrame, art_dir: str) -> DataFrame:
    """Score any cleaned frame table with the stored artifacts at the stored thresholds."""
    spark = frames.sparkSession
    prm = spark.read.parquet(f"{art_dir}/scaler").collect()  # one row per feature
    std = Standardizer({r.feature: r.mean for r in prm}, {r.feature: r.scale for r in prm})
    thr = spark.read.schema(sinks.THRESHOLDS_SCHEMA).json(f"{art_dir}/thresholds.json").first().models
    z = std.transform(frames)
    lr = LogisticRegressionModel.load(f"{art_dir}/logreg_model")
    weight = {r.label: r.weight for r in spark.read.parquet(f"{art_dir}/extratrees_weights").collect()}  # two rows
    trees = ExtraTrees.from_nodes(spark.read.parquet(f"{art_dir}/extratrees_nodes"), FEATURES, (weight[0], weight[1]))
    gnb = load_gnb(spark, f"{art_dir}/gnb_params")
    zv = assemble(z)
    parts = [
        ("logreg", score_column(lr.transform(zv), "probability")),
        ("extratrees", trees.transform(z)),
        ("gnb", gnb.transform(z)),
    ]
    out = None
    for key, scored in parts:
        t = float(thr[key]["thr_bestF1"])
        part = scored.select(F.lit(key).alias("model"), "frame_id", "label", "score", F.lit(t).alias("thr"), (F.col("score") >= t).cast("int").alias("pred"))
        out = part if out is None else out.unionByName(part)
    return out
