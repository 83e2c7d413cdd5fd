"""Session helpers: building a local session for tests/bench and finding the shared
work folder for lineage cuts and round-trip files."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "canframes") -> SparkSession:
    """Local session used by tests and the bench (the cluster supplies its own)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CANFRAMES_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster (``spark.checkpoint.dir``).

    Read from the session. Only a ``local`` master with nothing set (tests, bench) gets a
    fresh folder; on any other master a missing setting is an error, because a
    machine-local folder would be unreadable for the other executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="canframes-ckpt-", dir=os.environ.get("CANFRAMES_TMP", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root for written intermediate tables."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/canframes-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable lineage cut (survives executor loss): ``checkpoint`` into the shared dir."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def land(df: DataFrame, name: str, partition_by: list[str] | None = None, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: a lineage cut that
    keeps column pruning, filter pushdown and size statistics for what follows.

    A reader holds up to 4,096 rows of a row group as decoded arrays at once; ``group_rows`` limits
    the rows of a group, for tables with rows of many kilobytes."""
    path = work_path(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scoped_setting(spark: SparkSession, key: str, value: str):
    """A session setting for the jobs run inside the block only."""
    old = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def cluster_settings(input_bytes: int, target_partition_bytes: int = 256 << 20, max_partitions: int = 200_000) -> dict[str, str]:
    """Settings sized to the input: enough shuffle partitions that each holds about
    ``target_partition_bytes`` before AQE coalesces them, input splits of the same size,
    skew-join splitting on, RocksDB state for streams. Apply with ``spark.conf.set`` (or
    pass at submit time); nothing here is machine-local."""
    parts = max(200, min(max_partitions, -(-input_bytes // target_partition_bytes)))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }


def apply_settings(spark: SparkSession, settings: dict[str, str]) -> None:
    for k, v in settings.items():
        spark.conf.set(k, v)
