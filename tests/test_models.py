"""Model queries without SQL oracles, checked against brute force on small inputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from canframes.operators import metrics as M
from canframes.operators.learners import fit_and_score
from canframes.operators.online import _pass_fn, fit_online
from canframes.plans.q_scale import standardized
from canframes.schema import FEATURES
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def z(spark):
    df, _ = standardized(spark, SMALL)
    return df.cache()


def test_ridge_equals_closed_form(spark, z):
    train = z.filter(F.col("split") == "train")
    model, _ = fit_and_score("ridge", train, z.filter(F.col("split") == "test"))
    pdf = train.select(*FEATURES, "label").toPandas()
    X = pdf[FEATURES].to_numpy(dtype="float64")
    y = pdf["label"].to_numpy() * 2.0 - 1.0
    n1 = (pdf["label"] == 1).sum()
    n0 = len(pdf) - n1
    w = np.where(pdf["label"] == 1, len(pdf) / (2 * n1), len(pdf) / (2 * n0))
    # weighted ridge, alpha = 1 on the coefficients only, intercept free: centre by weighted means
    xm = (w[:, None] * X).sum(0) / w.sum()
    ym = (w * y).sum() / w.sum()
    Xc, yc = X - xm, y - ym
    A = Xc.T @ (w[:, None] * Xc) + np.eye(len(FEATURES))
    beta = np.linalg.lstsq(A, Xc.T @ (w * yc), rcond=None)[0]
    assert np.allclose(model.coefficients.toArray(), beta, atol=1e-8)
    assert model.intercept == pytest.approx(ym - xm @ beta, abs=1e-8)


def test_tree_and_forest_find_signal(spark, z):
    test = z.filter(F.col("split") == "test")
    train = z.filter(F.col("split") == "train")
    for name in ("tree", "forest"):
        _, scored = fit_and_score(name, train, test)
        auc = M.auc_and_totals(M.curve(scored.select(F.lit(name).alias("model"), "label", "score"))).first().auc
        assert auc > 0.8, (name, auc)


def test_parameter_mixing_one_partition_is_sequential_pass(spark, z):
    train = z.filter(F.col("split") == "train").limit(500)
    w = fit_online(train, kind="perceptron", epochs=1, partitions=1)
    # brute force: the same pass over the same row order, in numpy
    from canframes.functions.hashing import shuffle_key
    from canframes.operators.split import class_weights, with_class_weight

    rows = (
        with_class_weight(train, class_weights(train))
        .select("frame_id", "label", "weight", *[F.col(c).cast("double").alias(c) for c in FEATURES], shuffle_key("frame_id").alias("k"))
        .toPandas()
        .sort_values("k")
    )
    fn = _pass_fn(np.zeros(len(FEATURES) + 1), FEATURES, "perceptron")
    expect = next(fn(iter([rows.drop(columns="k")])))["w"][0]
    assert np.allclose(w, expect)


def _sequential_hinge(X, y, cw, alpha, epochs):
    """Hinge descent row after row with the step 1 / (alpha * t); mean loss met per epoch."""
    w, b, t, losses = np.zeros(X.shape[1]), 0.0, 0, []
    t0 = 1 / (alpha * (1 / alpha**0.5) ** 0.5)
    for _ in range(epochs):
        lost = 0.0
        for x, s, c in zip(X, y, cw, strict=True):
            eta = 1 / (alpha * (t0 + t))
            m = s * (w @ x + b)
            lost += max(0.0, 1 - m)
            w = w * (1 - eta * alpha)
            if m < 1:
                w, b = w + eta * c * s * x, b + eta * c * s
            t += 1
        losses.append(lost / len(X))
    return [*w, b], losses


def test_hinge_descent_one_partition_is_the_sequential_pass(spark, z):
    from canframes.functions.hashing import shuffle_key
    from canframes.operators.online import run_online
    from canframes.operators.split import class_weights, with_class_weight
    from canframes.schema import SGD_ALPHA

    train = z.filter(F.col("split") == "train").limit(400).cache()
    fit = run_online(train, "sgd_hinge", epochs=4, partitions=1)
    rows = with_class_weight(train, class_weights(train)).withColumn("k", shuffle_key("frame_id")).toPandas().sort_values("k")
    w, losses = _sequential_hinge(rows[FEATURES].to_numpy("float64"), np.where(rows["label"] > 0, 1.0, -1.0), rows["weight"].to_numpy("float64"), SGD_ALPHA, 4)
    assert np.allclose(fit.w, w) and np.allclose(fit.losses, losses)


def test_online_learners_stop_by_tolerance(spark, z):
    from canframes.operators.online import run_online

    train = z.filter(F.col("split") == "train").limit(300).cache()
    never = run_online(train, "sgd_hinge", epochs=7, partitions=2, tol=-1e9)
    assert not never.settled and len(never.losses) == 7
    fit = run_online(train, "sgd_hinge", epochs=100, partitions=2, patience=3)
    best = fit.losses.index(min(fit.losses))
    assert fit.settled and len(fit.losses) < 100 and all(x > min(fit.losses) - 1e-3 for x in fit.losses[-3:]) and best < len(fit.losses)
    with pytest.raises(ValueError, match="no rows"):
        run_online(train.limit(0), "pa")


def test_metric_row_shape(spark):
    import __spark_entry__ as entry

    df = entry.queries()["logreg_metrics"](spark, SMALL)
    assert df.columns == M.METRICS_TABLE_COLUMNS
    r = df.first()
    assert 0.0 <= r.auc <= 1.0 and r.thr_default == 0.5


def test_irls_equals_numpy_newton(spark, z):
    from canframes.operators.irls import fit_irls

    train = z.filter(F.col("split") == "train")
    beta = fit_irls(train)
    pdf = train.select(*FEATURES, "label").toPandas()
    X = np.hstack([pdf[FEATURES].to_numpy(dtype="float64"), np.ones((len(pdf), 1))])
    t = pdf["label"].to_numpy(dtype="float64")
    n1 = t.sum()
    w = np.where(t == 1, len(t) / (2 * n1), len(t) / (2 * (len(t) - n1)))
    b = np.zeros(X.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(X @ b)))
        g = b + X.T @ (w * (p - t))
        H = np.eye(len(b)) + X.T @ (X * (w * p * (1 - p))[:, None])
        b = b - np.linalg.solve(H, g)
    assert np.allclose(beta, b, atol=1e-7)


def test_train_evaluate_closed_form_models(spark):
    from canframes.plans.train_evaluate import train_evaluate

    metrics, audit = train_evaluate(spark, SMALL, learners={})
    models = {r.model: r for r in metrics.collect()}
    assert set(models) == {
        "Dummy(most_frequent)", "LogReg(balanced, IRLS)", "Perceptron(balanced)", "PassiveAggressive(balanced)",
        "SGD-hinge(balanced)", "GaussianNB", "ComplementNB(binned)", "BernoulliNB(binarized)",
    }
    assert models["Dummy(most_frequent)"].auc == 0.5 and models["GaussianNB"].auc > 0.8
    a = audit.first()
    assert a.n_overlap == 0 and a.n_dup == 0 and a.n_test > 0


def test_margin_and_sequence_models_beat_chance(spark):
    import __spark_entry__ as entry

    qs = entry.queries()
    floors = {"svc_metrics": 0.6, "sgd_hinge_metrics": 0.6, "seq_mlp_metrics": 0.52, "seq_id_mlp_metrics": 0.52}
    for name, floor in floors.items():
        r = qs[name](spark, SMALL).first()
        assert r.auc > floor, (name, r.auc)
        assert r.thr_default == (0.0 if name in ("svc_metrics", "sgd_hinge_metrics") else 0.5)


def test_boosted_windows_beat_the_network_on_held_out_ids(spark):
    import __spark_entry__ as entry

    qs = entry.queries()
    for boosted, network in (("seq_gbt_metrics", "seq_mlp_metrics"), ("seq_id_gbt_metrics", "seq_id_mlp_metrics")):
        b, n = qs[boosted](spark, SMALL).first(), qs[network](spark, SMALL).first()
        assert b.auc > 0.6 and b.auc > n.auc, (boosted, b.auc, n.auc)


def test_target_encoding_by_hand(spark):
    """Unseen and null keys take the overall share, a training row's own fold never counts, and
    neither the order of the rows nor the partitions matter."""
    import hashlib

    from canframes.operators.target_encoding import target_encode

    rows = [(i, ["a", "b", None, "hot"][min(i % 7, 3)], i % 3 == 0, "train") for i in range(300)]
    rows += [(1000 + i, k, False, "test") for i, k in enumerate(["a", "hot", "new", None])]
    df = spark.createDataFrame([(i, k, int(y), s) for i, k, y, s in rows], "frame_id long, ID string, label int, split string")
    fold = lambda i: int(hashlib.sha1(f"42:{i}".encode()).hexdigest()[:8], 16) % 5
    train = [r for r in rows if r[3] == "train"]
    prior = sum(r[2] for r in train) / len(train)
    want = {}
    for i, k, _, s in rows:
        mine = [r[2] for r in train if k is not None and r[1] == k and (s != "train" or fold(r[0]) != fold(i))]
        want[i] = (sum(mine) + 20 * prior) / (len(mine) + 20)
    for parts in (1, 7):
        got = {r.frame_id: r.id_rate for r in target_encode(df.repartition(parts), "ID").collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    with pytest.raises(ValueError):
        target_encode(df.filter("split = 'test'"), "ID")


def test_sequence_input_is_as_wide_with_any_number_of_ids(spark):
    from canframes.operators.seq_models import _sides, sequence_dataset

    widths = set()
    for ids in (6, 40):
        rows = [(i * 100 + k, f"id{i}", k, 30, float(k % 5 + i), int(k % 4 == 0)) for i in range(ids) for k in range(30)]
        fp = spark.createDataFrame(rows, "frame_id long, ID string, pos long, n_in_id long, x1 double, label int")
        data = sequence_dataset(fp, ["x1"], timesteps=4, with_id=True)
        widths.add(len(_sides(data, True, 1)[0].select("features").first()[0]))
    assert widths == {5}


def test_score_kind_is_found_from_the_columns(spark):
    from pyspark.ml.linalg import Vectors

    from canframes.operators.learners import score_column

    df = spark.createDataFrame([(Vectors.dense([0.3, 0.7]), Vectors.dense([-1.5, 1.5]), 1.0)], ["probability", "rawPrediction", "prediction"])
    assert score_column(df).first().score == 0.7
    assert score_column(df.drop("probability")).first().score == 1.5
    assert score_column(df.select("prediction")).first().score == 1.0
    assert score_column(df, "raw").first().score == 1.5
