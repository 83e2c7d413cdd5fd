"""The network on weighted copies and on chunks of windows: equal to ``pyspark.ml`` on the
copied rows, whatever the partitions; windows cut from chunks equal the windows themselves."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from canframes.operators import sequence as Q
from canframes.operators import sigmoid_net
from canframes.operators.learners import assemble, balanced_resample, class_rows, fit_and_score, resample_copies


def _rows(spark, n=300):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=n) > 0.5).astype(int)
    return spark.createDataFrame([(i, int(c), float(a), float(b)) for i, (c, (a, b)) in enumerate(zip(y, x, strict=True))], "frame_id long, label int, a double, b double")


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    layers = [3, 4, 2]
    sizes = list(zip(layers[:-1], layers[1:], strict=True))
    x, y, copies = rng.normal(size=(20, 3)), rng.integers(0, 2, 20), rng.integers(1, 4, 20).astype(float)
    theta = rng.normal(size=sum(a * b + b for a, b in sizes))
    _, grad = sigmoid_net.loss_and_gradient(x, y, copies, theta, sizes)
    for i in range(len(theta)):
        e = np.zeros(len(theta))
        e[i] = 1e-6
        up, down = (sigmoid_net.loss_and_gradient(x, y, copies, theta + s * e, sizes)[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - grad[i]) < 1e-5


def test_weighted_copies_equal_the_library_on_copied_rows(spark):
    """With blocks of one row the library's loss is the mean over the rows."""
    df = _rows(spark)
    rows = df.withColumn("copies", resample_copies(class_rows(df)))
    blocks = sigmoid_net.packed(rows.repartition(3), sigmoid_net.column_reader(["a", "b"]))
    mine = sigmoid_net.fit(blocks, tuple, [2, 4, 2], 6, 42)
    copied = assemble(balanced_resample(df), ["a", "b"]).repartition(1)
    lib = MultilayerPerceptronClassifier(layers=[2, 4, 2], maxIter=6, blockSize=1, seed=42).fit(copied)
    assert np.allclose(mine.weights.toArray(), lib.weights.toArray(), atol=1e-6)


def test_fit_does_not_depend_on_the_partitions(spark):
    df = _rows(spark)
    scores = []
    for parts in (1, 5):
        _, scored = fit_and_score("mlp", df.repartition(parts), df, ["a", "b"])
        scores.append(np.array([r.score for r in scored.orderBy("frame_id").collect()]))
    assert np.allclose(*scores, atol=1e-6)


def test_no_rows_raise(spark):
    blocks = sigmoid_net.packed(_rows(spark).withColumn("copies", F.lit(1)).limit(0), sigmoid_net.column_reader(["a", "b"]))
    with pytest.raises(ValueError):
        sigmoid_net.fit(blocks, tuple, [2, 4, 2], 3, 1)


def test_windows_cut_from_chunks_equal_the_windows(spark):
    """IDs of several chunks, one too short for a window; every window once, with its frames."""
    from canframes.operators.seq_models import CHUNK_WINDOWS, _chunk_reader, _cut, sequence_chunks, windows_of

    n = {"a": 2 * CHUNK_WINDOWS + 30, "b": 3, "c": 50, "d": CHUNK_WINDOWS, "e": 40}
    rows = [(i * 10000 + k, name, k, size, float((k * 7 + i) % 11), float(k % 3), int(k % 5 == 0)) for i, (name, size) in enumerate(n.items()) for k in range(size)]
    fp = spark.createDataFrame(rows, "frame_id long, ID string, pos long, n_in_id long, x1 double, x2 double, label int")
    chunks = sequence_chunks(fp, ["x1", "x2"], timesteps=4, step=2, label_rule="any", with_id=True)
    assert chunks.select(F.max(F.size("windows"))).first()[0] <= CHUNK_WINDOWS
    got = {r.start_frame_id: r for r in windows_of(chunks).collect()}
    want = {r.start_frame_id: r for r in Q.sequence_windows(fp, 4, 2, "any", frames_of=["x1", "x2"]).collect()}
    assert got.keys() == want.keys() and all(got[k].y == want[k].y and got[k].start == want[k].start for k in want)
    a, b = (np.array([list(v) for v in vs]) for vs in ([got[k].x for k in want], [want[k].frames for k in want]))
    for f in (0, 1):  # scaled: one affine map for all offsets of a feature
        slope, offset = np.polyfit(b[:, f::2].ravel(), a[:, f::2].ravel(), 1)
        assert np.allclose(a[:, f::2], slope * b[:, f::2] + offset, atol=1e-9)
    counts = {s: {} for s in ("train", "test")}
    for r in got.values():
        counts[r.split][r.y] = counts[r.split].get(r.y, 0) + r.copies
    assert len(set(counts["train"].values())) <= 2 and max(counts["train"].values()) - min(counts["train"].values()) < 30
    seen = 0
    for batch in chunks.select("frames", "windows").toArrow().to_batches():
        for block in _chunk_reader(2, True)(batch):
            x, y, copies = _cut(4)(block)
            assert x.shape == (len(y), 9) and len(copies) == len(y)
            seen += len(y)
    assert seen == len(want)
