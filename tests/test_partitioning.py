"""Results do not depend on partitioning; positions, blocked windows and running sums equal
plain windows at every partition count."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from canframes.operators import metrics as M
from canframes.operators import sequence as Q
from canframes.operators.positions import with_positions
from canframes.plans.fixtures import clean_view, scores
from canframes.plans.q_split import prepared
from tests.conftest import SMALL, rows


def test_split_same_under_partitionings(spark):
    base = rows(prepared(spark, SMALL).select("frame_id", "split"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 13):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            df = prepared(spark, SMALL).select("frame_id", "split")
            assert rows(df.repartition(n)) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    n_test = sum(1 for _, s in base if s == "test")
    assert 0 < n_test < len(base)


def test_split_exact_group_count(spark):
    df = prepared(spark, SMALL)
    g = df.groupBy("split").agg(F.countDistinct("group_key").alias("g")).collect()
    by = {r.split: r.g for r in g}
    total = df.select("group_key").distinct().count()
    assert by["test"] == -(-2 * total // 10)  # ceil(0.2 * G)
    assert by["test"] + by["train"] == total


def test_positions_equal_a_plain_window(spark):
    """Text, tied and null times and null keys, at several partition counts."""
    cv = clean_view(spark, SMALL)
    text = F.when(F.col("frame_id") % 7 == 0, F.lit(None)).otherwise((F.col("frame_id") * 37 % 400).cast("string"))
    for df, order in ((cv, ["ts", "frame_id"]), (cv.withColumn("ts", text), ["ts", "frame_id"])):
        df = df.withColumn("ID", F.when(F.col("frame_id") % 11 != 0, F.col("ID")))
        w = Window.partitionBy("ID")
        by = [F.col(c).asc_nulls_last() for c in order]
        plain = rows(df.select("frame_id", (F.row_number().over(w.orderBy(*by)) - 1).cast("long").alias("pos"), F.count("*").over(w).alias("n_in_id")))
        for parts in (1, 3, 16):
            assert rows(with_positions(df.repartition(7), "ID", order, parts=parts).select("frame_id", "pos", "n_in_id")) == plain


def test_blocked_windows_equal_plain(spark):
    cv = clean_view(spark, SMALL)
    fp = Q.positions(cv)
    fp_b = Q.positions(cv, parts=31)
    ctx = rows(Q.add_sequence_context(fp).select("frame_id", *Q.context_features()))
    assert rows(Q.add_sequence_context(fp_b, block_rows=6).select("frame_id", *Q.context_features())) == ctx
    for rule, T in (("any", 10), ("last", 20), ("ratio", 20)):
        w = rows(Q.sequence_windows(fp, timesteps=T, label_rule=rule))
        assert rows(Q.sequence_windows(fp_b, timesteps=T, label_rule=rule, block_rows=T + 3)) == w


def test_curve_equals_plain(spark):
    s = scores(spark, SMALL)
    plain = rows(M.curve(s, parts=1))
    assert rows(M.curve(s.repartition(5), parts=16)) == plain
    assert rows(M.curve(s, parts=64)) == plain


def test_queries_independent_of_partitioning(spark):
    import __spark_entry__ as entry

    qs = entry.queries()
    names = ["group_split", "seq_context", "windows_ratio", "eval_with_thresholds", "csv_round_trip", "quantized", "cnb_scores"]
    conf = {"spark.sql.shuffle.partitions": None, "spark.sql.files.maxPartitionBytes": None, "spark.sql.adaptive.enabled": None}
    for k in conf:
        conf[k] = spark.conf.get(k)
    results = []
    try:
        for parts, split_bytes, aqe in (("1", "134217728", "false"), ("13", "4096", "true")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
            spark.conf.set("spark.sql.adaptive.enabled", aqe)
            results.append({n: rows(qs[n](spark, SMALL)) for n in names})
    finally:
        for k, v in conf.items():
            spark.conf.set(k, v)
    for n in names:
        assert results[0][n] == results[1][n], n
