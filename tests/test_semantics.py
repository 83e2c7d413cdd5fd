"""Hand-worked micro tables for the rules that are easy to get wrong."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from canframes.functions.clean import drop_incomplete, normalize_label, read_and_clean
from canframes.operators import metrics as M
from canframes.operators import sequence as Q
from canframes.operators.scale import Standardizer, UniformBinner
from canframes.schema import FEATURES


def frames_df(spark, rows, with_ts=True):
    """rows: (frame_id, ID, label, [DATA_0..DATA_7] or single value)."""
    out = []
    for fid, idv, lab, data in rows:
        vals = data if isinstance(data, list) else [float(data)] * 8
        out.append((fid, idv, fid, lab, *[float(v) if v is not None else None for v in vals]))
    schema = "frame_id long, ID string, t long, label int, " + ", ".join(f"{c} double" for c in FEATURES)
    df = spark.createDataFrame(out, schema)
    return df.withColumn("ts", F.timestamp_seconds("t")).drop("t") if with_ts else df.drop("t")


# --- cleaning ---------------------------------------------------------------------------------

def test_label_text_map(spark):
    df = spark.createDataFrame([(s,) for s in ["benign", "Benign", "0", "ATTACK", "1", "1.0", " 1", "unknown", None]], "label string")
    got = [r[0] for r in df.select(normalize_label("label")).collect()]
    assert got == [0, 0, 0, 1, 1, None, None, None, None]


def test_missing_required_column_raises(spark):
    df = spark.createDataFrame([("1",) * 8], ", ".join(f"{c} string" for c in FEATURES[:7]) + ", label string")
    with pytest.raises(ValueError, match="DATA_7"):
        read_and_clean(df)


def test_bad_numbers_become_null_and_rows_drop(spark):
    df = spark.createDataFrame([("bad", "1"), ("NaN", "0"), ("2.5", "benign")], "DATA_0 string, label string")
    out = drop_incomplete(read_and_clean(df.withColumn("ID", F.lit("a")), features=["DATA_0"]))
    assert [(r.DATA_0, r.label) for r in out.collect()] == [(2.5, 0)]


def test_synthetic_ids_from_position(spark):
    df = spark.range(0, 120).select(F.col("id").alias("class_pos"), F.lit("1").alias("DATA_0"), F.lit("1").alias("label"))
    out = read_and_clean(df, features=["DATA_0"]).select("class_pos", "ID").collect()
    ids = {r.class_pos: r.ID for r in out}
    assert ids[0] == "gid_0" and ids[49] == "gid_0" and ids[50] == "gid_1" and ids[119] == "gid_2"


# --- sequence windows ---------------------------------------------------------------------------

def test_short_and_exact_ids(spark):
    rows = [(i, "short", 0, i) for i in range(9)] + [(100 + i, "exact", 1 if i == 9 else 0, i) for i in range(10)]
    fp = Q.positions(frames_df(spark, rows))
    win = Q.sequence_windows(fp, timesteps=10, label_rule="last").collect()
    assert [(r.ID, r.start, r.y) for r in win] == [("exact", 0, 1)]


def test_ratio_met_exactly(spark):
    labels = [1] * 6 + [0] * 14
    rows = [(i, "a", labels[i], i) for i in range(20)]
    fp = Q.positions(frames_df(spark, rows))
    assert Q.sequence_windows(fp, timesteps=20, label_rule="ratio", pos_ratio=0.3).first().y == 1
    assert Q.sequence_windows(fp, timesteps=20, label_rule="ratio", pos_ratio=0.31).first().y == 0


def test_step_three_and_counts(spark):
    rows = [(i, "a", 0, i) for i in range(25)]
    fp = Q.positions(frames_df(spark, rows))
    starts = sorted(r.start for r in Q.sequence_windows(fp, timesteps=10, step=3).collect())
    assert starts == [0, 3, 6, 9, 12, 15] and len(starts) == Q.n_windows(25, 10, 3)


def test_null_inside_rolling_window(spark):
    vals = [1.0, 2.0, 3.0, None, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0]
    rows = [(i, "a", 0, [vals[i]] + [0.0] * 7) for i in range(10)]
    ctx = Q.add_sequence_context(Q.positions(frames_df(spark, rows))).orderBy("pos").collect()
    means = [r.DATA_0_roll5_mean for r in ctx]
    # frames 3..7 hold the null in their 5-frame window -> 0; frame 8 is the first full one
    assert means[:8] == [0.0] * 8 and means[8] == pytest.approx(7.0) and means[9] == pytest.approx(8.0)
    assert ctx[9].DATA_0_roll5_std == pytest.approx(math.sqrt(2.5))
    assert ctx[3].DATA_0 == 0.0  # the null itself is filled


def test_weighted_scaler_equals_explode(spark):
    rows = [(i, "a" if i < 23 else "b", 0, [float(i % 7)] * 8) for i in range(40)]
    fp = Q.positions(frames_df(spark, rows))
    for step in (1, 3):
        w = {r.feature: (r.mean, r.scale) for r in Q.weighted_scaler(fp, timesteps=10, step=step).collect()}
        cont = Q.window_contents(fp, timesteps=10, step=step)
        m = cont.agg(F.avg("DATA_0"), F.stddev_pop("DATA_0")).first()
        assert w["DATA_0"][0] == pytest.approx(m[0]) and w["DATA_0"][1] == pytest.approx(m[1])


# --- scaling / binning ---------------------------------------------------------------------------

def test_constant_feature(spark):
    rows = [(i, "a", i % 2, [float(i), 4.0] + [0.0] * 6) for i in range(10)]
    df = frames_df(spark, rows)
    std = Standardizer.fit(df)
    assert std.scale["DATA_1"] == 1.0 and std.mean["DATA_1"] == 4.0
    assert std.scale["DATA_0"] == pytest.approx(math.sqrt(8.25))
    b = UniformBinner.fit(df, 16).transform(df).select("DATA_0_bin", "DATA_1_bin").collect()
    assert {r.DATA_1_bin for r in b} == {0}
    assert sorted(r.DATA_0_bin for r in b) == [0, 1, 3, 5, 7, 8, 10, 12, 14, 15]


# --- metrics --------------------------------------------------------------------------------------

def scores_df(spark, pairs, model="m"):
    return spark.createDataFrame([(model, i, lab, float(s)) for i, (lab, s) in enumerate(pairs)], "model string, frame_id long, label int, score double")


def test_all_scores_equal(spark):
    df = scores_df(spark, [(1, 0.3), (0, 0.3), (1, 0.3), (0, 0.3)])
    cum = M.curve(df)
    assert M.auc_and_totals(cum).first().auc == 0.5
    best = M.best_threshold_by_f1(cum).first()
    assert best.threshold == 0.3 and best.recall == 1.0


def test_single_class_auc_nan(spark):
    df = scores_df(spark, [(1, 0.1), (1, 0.7)])
    assert math.isnan(M.auc_and_totals(M.curve(df)).first().auc)


def test_all_f1_zero_takes_lowest_threshold(spark):
    df = scores_df(spark, [(0, 0.2), (0, 0.9), (0, 0.5)])
    ev = M.eval_with_thresholds(df).first()
    assert ev.thr_bestF1 == 0.2 and ev.bestF1 == 0.0 and ev.f1_b == 0.0


def test_f1_tie_takes_lowest_threshold(spark):
    # thresholds 0.8 and 0.4 give the same F1 (2/3): P=1/1,R=1/2 vs P=2/4,R=2/2
    df = scores_df(spark, [(1, 0.8), (0, 0.6), (0, 0.5), (1, 0.4)])
    best = M.best_threshold_by_f1(M.curve(df)).first()
    assert best.threshold == 0.4


def test_default_threshold_rule(spark):
    df = scores_df(spark, [(1, 0.9), (0, 0.1)]).unionByName(scores_df(spark, [(1, 2.0), (0, -1.0)], model="svm"))
    rule = {r.model: r.thr_default for r in M.threshold_rule(df).collect()}
    assert rule == {"m": 0.5, "svm": 0.0}


def test_auc_symmetry_and_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from canframes.plans.fixtures import scores
    from tests.conftest import SMALL

    s = scores(spark, SMALL).filter("model = 'a'")
    auc = M.auc_and_totals(M.curve(s)).first().auc
    neg = M.auc_and_totals(M.curve(s.withColumn("score", -F.col("score")))).first().auc
    assert auc == pytest.approx(0.449404133, abs=1e-9)
    assert neg == pytest.approx(1 - auc, abs=1e-12)
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    assert ev.evaluate(s.withColumn("label", F.col("label").cast("double"))) == pytest.approx(auc, abs=1e-12)


def test_roc_drops_equal_steps(spark):
    # four positives with distinct scores then four negatives: points on straight runs go
    df = scores_df(spark, [(1, 0.9), (1, 0.8), (1, 0.7), (1, 0.6), (0, 0.5), (0, 0.4), (0, 0.3), (0, 0.2)])
    pts = sorted((r.fpr, r.tpr) for r in M.roc_curve(M.curve(df)).collect())
    assert pts == [(0.0, 0.0), (0.0, 0.25), (0.0, 1.0), (1.0, 1.0)]


def test_pr_curve_end_point_and_ap(spark):
    df = scores_df(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)])
    cum = M.curve(df)
    pts = M.pr_curve(cum).collect()
    assert any(r.threshold is None and r.precision == 1.0 and r.recall == 0.0 for r in pts)
    # AP = 0.5 * 1 + 0.5 * 2/3
    assert M.average_precision(cum).first().ap == pytest.approx(0.5 + 1 / 3)


def test_overlap_assertion_and_distinct_counts(spark):
    from canframes.operators.split import assert_no_overlap, distinct_counts

    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train")], "group_key string, split string")
    with pytest.raises(AssertionError, match="1 groups"):
        assert_no_overlap(df)
    assert_no_overlap(df.filter("group_key = 'b'"))
    exact = distinct_counts(df, ["group_key", "split"]).first()
    approx = distinct_counts(df, ["group_key", "split"], exact=False).first()
    assert tuple(exact) == (2, 2) == tuple(approx)


def test_read_and_clean_from_path(spark):
    from canframes.session import work_path
    from canframes.sources.frame_csv import write_ordered_csv

    df = spark.createDataFrame([(i, str(i % 3), "attack" if i % 2 else "benign") for i in range(120)], "o long, DATA_0 string, label string")
    path = work_path(spark, "single")
    write_ordered_csv(df, path, "o")
    out = read_and_clean(path, features=["DATA_0"]).orderBy("class_pos").collect()
    assert [r.ID for r in out][::50] == ["gid_0", "gid_1", "gid_2"] and out[1].label == 1 and out[1].DATA_0 == 1.0


def test_byte_exact_row_hash(spark):
    import hashlib

    import numpy as np

    from canframes.functions.hashing import row_hash, row_hash_bytes

    rows = [(1, [1.0, 2.0, 3.0, 0.0, 255.0, 7.5, -0.0, 0.1]), (2, [1.0, 2.0, 3.0, 0.0, 255.0, 7.5, 0.0, 0.1])]
    df = spark.createDataFrame([(i, *v) for i, v in rows], "frame_id long, " + ", ".join(f"{c} double" for c in FEATURES))
    got = {r.frame_id: (r.b, r.t) for r in df.select("frame_id", row_hash_bytes().alias("b"), row_hash().alias("t")).collect()}
    for i, v in rows:
        assert got[i][0] == hashlib.sha1(np.asarray(v, dtype="float32").tobytes()).hexdigest()
    assert got[1][0] != got[2][0]  # the byte digest separates -0.0 from 0.0
    assert got[1][1] != got[2][1]  # so does the text key ("-0.0" vs "0.0"), unlike plain grouping


def test_scaler_of_large_values_does_not_cancel(spark):
    df = spark.createDataFrame([(1e9 + i % 3, 0.0) for i in range(3000)], "x double, k double")
    got = {r.feature: (r.mean, r.scale) for r in _scaler_rows(df)}
    assert abs(got["x"][1] - (2 / 3) ** 0.5) < 1e-9 and got["k"] == (0.0, 1.0)


def _scaler_rows(df):
    from canframes.operators.scale import scaler_params

    return scaler_params(df, ["x", "k"]).collect()


def test_ids_of_digits_sort_as_numbers(spark):
    from canframes.operators.sequence import id_index

    def index(ids):
        return {r.ID: r.id_idx for r in id_index(spark.createDataFrame([(i,) for i in ids], "ID string")).collect()}

    assert index(["10", "2", "300", "2", None]) == {"2": 0, "10": 1, "300": 2}
    assert index(["10", "2", "gid_1"]) == {"10": 0, "2": 1, "gid_1": 2}


def test_number_forms(spark):
    import re

    from canframes.functions.clean import parse_number

    form = re.compile(r"[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?|inf|infinity)", re.I)
    texts = ["1", " 1\t", "\n-2.5 ", "+.5", "5.", "1e3", "1E-2", "1.e5", ".", "", " ", "e5", "1e", "1D", "1d", "0F", "1.f", "2.5F", "1e5f", "0x1p3", "0X10", "nan", "NaN", "+nan"]
    texts += ["inf", "-Inf", "+Infinity", "INFINITY", "infinit", "Infinityf", "1 2", "1_0", "--1", "\x015", "5\x1f", "5\x0b", "1,5", "bad", "١", "1e400", "dead", "f", "F5"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(len(texts), None)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", parse_number("t", "double").alias("v")).collect()}
    for i, t in enumerate(texts):
        core = t.strip(" \t\n\x0b\f\r")
        assert got[i] == (float(core) if form.fullmatch(core) else None), repr(t)
    assert got[len(texts)] is None


def test_roc_points_dropped_across_partition_edges(spark):
    """Equal steps are found where the next point lies in another partition or block of ties."""
    from canframes.operators import metrics as M

    rows = [(m, k, float(k), 1 if (k * 7 + (m == "a") * 3) % 5 < 2 else 0) for m in ("a", "b") for k in range(400)]
    rows += [("c", 0, 1.0, 1), ("d", 0, 2.0, 0), ("d", 1, 1.0, 0)]
    df = spark.createDataFrame(rows, "model string, i int, score double, label int")
    want = None
    for parts in (1, 3, 16):
        got = sorted(tuple(r) for r in M.roc_curve(M.curve(df, parts)).select("model", "threshold", "tpr").collect() if r.model != "d")
        want = want or got
        assert got == want
    expect = []
    for m in ("a", "b"):
        steps = [lab for _, lab in sorted(((s, lab) for mm, _, s, lab in rows if mm == m), reverse=True)]
        scores = sorted((s for mm, _, s, _ in rows if mm == m), reverse=True)
        expect += [(m, s) for k, s in enumerate(scores) if k in (0, len(scores) - 1) or steps[k] != steps[k + 1]]
    assert sorted((r[0], r[1]) for r in want if r[0] in "ab" and r[1] != float("inf")) == sorted(expect)


def test_float32_bytes_of_every_kind_of_value(spark):
    """Zeros of both signs, denormals, powers of two and their neighbours, infinities, NaN, null."""
    import struct

    import numpy as np

    from canframes.functions.hashing import float32_hex

    rng = np.random.default_rng(3)
    patterns = {0, 1, 2, 0x007FFFFF, 0x00800000, 0x7F7FFFFF, 0x7F800000, *[e << 23 for e in range(255)]}
    patterns |= {p + d for p in list(patterns) for d in (-1, 1) if 0 <= p + d <= 0x7F800000}
    patterns |= {int(x) for x in rng.integers(0, 0x7F800000, 4000)}
    bits = sorted(patterns | {p | 0x80000000 for p in patterns})
    values = [struct.unpack("<f", struct.pack("<I", b))[0] for b in bits]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*values, float("nan"), None])], "i int, v float")
    got = {r.i: r.h for r in df.select("i", float32_hex("v").alias("h")).collect()}
    assert [got[i] for i in range(len(bits))] == [struct.pack("<I", b).hex().upper() for b in bits]
    assert got[len(bits)] == got[len(bits) + 1] == "0000C07F"


def test_sketches_merge_over_files(spark):
    from canframes.operators.split import distinct_sketches, merged_distinct

    df = spark.range(60000).selectExpr("id % 20000 AS k", "CAST(id % 3 AS STRING) AS few", "id % 6 AS file", "IF(id % 2 = 0, id, NULL) AS half")
    stored = distinct_sketches(df, ["k", "few", "half"], ["file"])
    got = merged_distinct(stored, ["k", "few", "half"]).first()
    assert abs(got.n_k - 20000) < 20000 * 3 * 1.04 / 128 and got.n_few == 3 and abs(got.n_half - 30000) < 30000 * 3 * 1.04 / 128
    per = {r.file: r.n_few for r in merged_distinct(stored, ["few"], ["file"]).collect()}
    assert per == {f: 1 for f in range(6)}
    assert merged_distinct(stored.filter("file < 0"), ["k"]).first().n_k in (0, None)
