"""Session helpers: the shared work folder comes from the session; settings are sized."""

from __future__ import annotations

from canframes.session import checkpoint_root, cluster_settings, work_path


def test_checkpoint_root_is_the_sessions_folder(spark):
    root = checkpoint_root(spark)
    assert root == spark.sparkContext.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert configured.rstrip("/").split(":")[-1] in root
    p1, p2 = work_path(spark, "x"), work_path(spark, "x")
    assert p1 != p2 and p1.startswith(root.rstrip("/"))


def test_cluster_settings_scale_with_input():
    small = cluster_settings(10 << 20)
    big = cluster_settings(100 << 40)
    assert small["spark.sql.shuffle.partitions"] == "200"
    assert big["spark.sql.shuffle.partitions"] == "200000"
    mid = cluster_settings(1 << 40)
    assert mid["spark.sql.shuffle.partitions"] == str((1 << 40) // (256 << 20))
    assert big["spark.sql.adaptive.enabled"] == "true" and big["spark.sql.adaptive.skewJoin.enabled"] == "true"
