"""CSV sources: file order across many input splits, class by file, missing columns,
prediction-file checks, and the artifact sinks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from canframes.functions.clean import to_float32
from canframes.plans.fixtures import frames_raw_with_source, scores
from canframes.schema import FEATURES
from canframes.session import work_path
from canframes.sources.frame_csv import load_frames, scan_csv, with_file_positions, write_ordered_csv, write_source_files
from canframes.sources.score_csv import compare_files, pick_columns
from tests.conftest import SMALL, rows


def test_file_order_over_many_splits(spark):
    """Positions stay exact when each file is cut into many small input splits."""
    df = spark.range(0, 5000).select(F.col("id").alias("k"), (F.col("id") * 7 % 13).cast("string").alias("v"))
    out = work_path(spark, "order")
    write_ordered_csv(df.withColumn("o", F.col("k")), out, "o")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        back = with_file_positions(scan_csv(spark, out, "x", 0))
        assert back.rdd.getNumPartitions() > 5
        got = back.select(F.col("k").cast("long"), "frame_seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(r[0] == r[1] for r in got) and len(got) == 5000


def test_positions_survive_a_replanned_scan(spark):
    """Rows and positions do not change if settings that cut scans change after loading."""
    out = work_path(spark, "replan")
    write_source_files(frames_raw_with_source(spark, SMALL), out, drop=["frame_id"])
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = {k: spark.conf.get(k) for k in keys}
    before = rows(load_frames(spark, out, partitioned=True).frames.select("source", "frame_seq", *FEATURES))
    try:
        loaded = load_frames(spark, out, partitioned=True)
        spark.conf.set(keys[0], "3000")
        spark.conf.set(keys[1], "10")
        assert rows(loaded.frames.select("source", "frame_seq", *FEATURES)) == before
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_missing_tokens_and_strict_numbers(spark):
    text = ["ID,ts,DATA_0", "NA,1,1", "1,NaN,1", "1,1, 5 ", "1,1,1D", "1,1,0x1p3", "1,1,null", "1,1,1e2", "1,1,inf"]
    path = work_path(spark, "tokens")
    spark.createDataFrame([(x,) for x in text], "value string").coalesce(1).write.text(path)
    df = scan_csv(spark, path, "t", 0)
    got = df.select("ID", "ts", to_float32("DATA_0").alias("v")).collect()
    assert [r.v for r in got] == [1.0, 1.0, 5.0, None, None, None, 100.0, float("inf")]
    assert got[0].ID is None and got[1].ts is None


def test_round_trip_labels_by_file(spark):
    out = work_path(spark, "rt")
    write_source_files(frames_raw_with_source(spark, SMALL), out, drop=["frame_id"])
    loaded = load_frames(spark, out, partitioned=True)
    by_src = {r.source: r.labels for r in loaded.frames.groupBy("source").agg(F.collect_set("label").alias("labels")).collect()}
    assert by_src.pop("decimal_benign.csv") == [0]
    assert all(v == [1] for v in by_src.values()) and len(by_src) == 5
    # before the row drop the attack table keeps rows with a bad payload (as nulls)
    assert loaded.attack_df.filter(F.col("DATA_0").isNull()).count() > 0
    assert loaded.frames.filter(F.col("DATA_0").isNull()).count() == 0


def test_missing_payload_column_raises(spark):
    out = work_path(spark, "nodata7")
    write_source_files(frames_raw_with_source(spark, SMALL), out, drop=["frame_id", "DATA_7"])
    with pytest.raises(ValueError, match="DATA_7"):
        load_frames(spark, out, partitioned=True)


def test_pick_columns_rules():
    assert pick_columns(["Prob", "Label"]) == ("Label", "Prob")
    assert pick_columns(["score", "target", "label", "confidence"]) == ("label", "score")
    assert pick_columns(["LABEL", "label", "prob"]) == ("label", "prob")  # later duplicate wins
    with pytest.raises(ValueError):
        pick_columns(["x", "prob"])


def _write_pred(spark, df, name):
    p = work_path(spark, name)
    write_ordered_csv(df, p, "frame_id")
    return p


def test_unequal_lengths_and_unmapped_labels_raise(spark):
    s = scores(spark, SMALL).filter("model = 'a'")
    a = _write_pred(spark, s.select("frame_id", F.when(F.col("label") == 1, "ATTACK").otherwise("BENIGN").alias("Label"), F.col("score").alias("prob")), "pa")
    b = _write_pred(spark, s.filter("frame_id % 2 = 0").select("frame_id", "label", F.col("score").alias("score")), "pb")
    with pytest.raises(AssertionError, match="unequal length"):
        compare_files(spark, ("a", a), ("b", b)).count()
    bad = _write_pred(spark, s.select("frame_id", F.when(F.col("label") == 1, "malicious").otherwise("benign").alias("label"), F.col("score").alias("prob")), "pc")
    with pytest.raises(ValueError, match="without a 0/1 meaning"):
        compare_files(spark, ("c", bad), ("a", a))


def test_numeric_truth_and_bad_scores(spark):
    s = scores(spark, SMALL).filter("model = 'a'")
    a = _write_pred(spark, s.select("frame_id", "label", F.when(F.col("frame_id") % 50 == 0, "x").otherwise(F.col("score").cast("string")).alias("y_score")), "pn")
    long = compare_files(spark, ("a", a), ("b", a))
    got = rows(long.filter("model = 'a'").select("frame_seq", "label", "score").filter("frame_seq < 3"))
    exp = rows(s.orderBy("frame_id").limit(3).select(F.col("frame_id"), "label", F.when(F.col("frame_id") % 50 == 0, 0.0).otherwise(F.col("score"))))
    assert got == exp


def test_artifact_export_and_scoring(spark):
    from canframes.plans.export import export_artifacts, score_with_artifacts

    out = work_path(spark, "artifacts")
    metrics = export_artifacts(spark, SMALL, out)
    table = metrics.collect()
    assert {r.model for r in table} == {"LogReg(balanced)", "GaussianNB", "ExtraTrees(d=8,100)"}
    assert set(metrics.columns) == {
        "model", "thr_default", "acc", "prec", "rec", "f1", "auc", "thr_bestF1", "acc_bestF1", "prec_bestF1", "rec_bestF1", "f1_bestF1"
    }
    back = spark.read.option("header", True).csv(f"{out}/metrics.csv")
    assert back.count() == 3
    thr = spark.read.json(f"{out}/thresholds.json").first()
    assert thr.features == FEATURES and set(thr.models.asDict()) == {"logreg", "gnb", "extratrees"}
    scored = score_with_artifacts(spark, SMALL, out)
    assert {r.model for r in scored.select("model").distinct().collect()} == {"logreg", "gnb", "extratrees"}


def test_numeric_truth_with_missing_values_raises(spark):
    s = scores(spark, SMALL).filter("model = 'a'")
    p = _write_pred(spark, s.select("frame_id", F.when(F.col("frame_id") % 7 == 0, None).otherwise(F.col("label")).alias("target"), F.col("score").alias("prob")), "pm")
    with pytest.raises(ValueError, match="missing values"):
        compare_files(spark, ("a", p), ("b", p))


def test_command_line_train_evaluate_on_csv_files(spark):
    from canframes.__main__ import main

    data = work_path(spark, "cli-in")
    write_source_files(frames_raw_with_source(spark, SMALL), data, drop=["frame_id"])
    out = work_path(spark, "cli-out")
    main(["train-evaluate", data, out, "--partitioned"])
    metrics = spark.read.option("header", True).csv(f"{out}/metrics.csv")
    assert metrics.count() == 20  # every detector of the flow
    audit = spark.read.option("header", True).csv(f"{out}/leakage_audit.csv").first()
    assert audit.n_overlap == "0" and audit.n_dup == "0"


def test_command_line_compare(spark):
    from canframes.__main__ import main
    from canframes.operators import metrics as M

    s = scores(spark, SMALL)
    a = _write_pred(spark, s.filter("model = 'a'").select("frame_id", F.when(F.col("label") == 1, "ATTACK").otherwise("BENIGN").alias("Label"), F.col("score").alias("Prob")), "cli-a")
    b = _write_pred(spark, s.filter("model = 'b'").select("frame_id", F.col("label").alias("y_true"), F.col("score").alias("confidence")), "cli-b")
    out = work_path(spark, "cli-cmp")
    main(["compare", a, b, out])
    got = {r.model: float(r.auc) for r in spark.read.option("header", True).csv(f"{out}/roc_auc.csv").collect()}
    exp = {r.model: r.auc for r in M.auc_and_totals(M.curve(s)).collect()}
    assert abs(got["first"] - exp["a"]) < 1e-12 and abs(got["second"] - exp["b"]) < 1e-12
    assert spark.read.option("header", True).csv(f"{out}/roc_curve.csv").count() > 0


def test_command_line_export_on_csv_files(spark):
    from canframes.__main__ import main

    data = work_path(spark, "cli-ex-in")
    write_source_files(frames_raw_with_source(spark, SMALL), data, drop=["frame_id"])
    out = work_path(spark, "cli-ex-out")
    main(["export", data, out, "--partitioned", "--tune-on", "test"])
    assert spark.read.option("header", True).csv(f"{out}/metrics.csv").count() == 3
    meta = spark.read.json(f"{out}/meta.json").first()
    assert meta.features == FEATURES and set(meta.splits.asDict()) == {"train", "test"}


def test_an_ordered_table_is_written_in_parts(spark):
    import glob

    from canframes.__main__ import main
    from canframes.operators import metrics as M

    s = scores(spark, SMALL)
    a = _write_pred(spark, s.filter("model = 'a'").select("frame_id", F.col("label").alias("target"), F.col("score").alias("prob")), "parts-a")
    b = _write_pred(spark, s.filter("model = 'b'").select("frame_id", F.col("label").alias("target"), F.col("score").alias("prob")), "parts-b")
    out = work_path(spark, "cli-parts")
    merge = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        main(["compare", a, b, out])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merge)
    parts = sorted(glob.glob(f"{out.removeprefix('file:')}/roc_curve.csv/part-*.csv"))
    assert len(parts) > 1
    rows = []
    for f in parts:
        with open(f) as lines:
            head, *body = lines.read().splitlines()
        assert head == "model,threshold,fpr,tpr"
        rows += [(m, float(x), float(y)) for m, _, x, y in (r.split(",") for r in body)]
    assert rows == sorted(rows)
    whole = spark.read.option("header", True).csv(f"{out}/roc_curve.csv")
    assert len(rows) == whole.count() == M.roc_curve(M.shared_curve(s)).count()
