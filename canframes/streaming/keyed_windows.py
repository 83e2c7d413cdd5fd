"""Sliding count-windows per ID in the stream engine's keyed state.

Each ID keeps what a window can still need: how many frames it has had and its last T - 1
frames (time, frame id, label). A micro-batch sorts an ID's new frames by time, emits every
window that ends in one of them, and stores the new tail, so state is T - 1 frames per ID
whatever the length of the stream, and a restart goes on from the checkpoint. A frame not
later than the last one taken for its ID, or without a time, is late: it belongs to no window and
goes out as a side row (``late`` = true). Frames without an ID belong to no sequence.

With ``idle`` an ID that has had no frame for that long behind the watermark leaves the state
(its numbering starts again if it comes back), so the number of IDs held is bounded too; the
engine then drops frames behind the watermark before they get here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT_SCHEMA = "ID string, start long, start_frame_id long, y int, late boolean"
STATE_SCHEMA = "seen long, us array<long>, frame_id array<long>, label array<int>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def window_labels(label: np.ndarray, starts: np.ndarray, timesteps: int, rule: str, pos_ratio: float) -> np.ndarray:
    """Label of the windows that begin at ``starts`` (indices into ``label``)."""
    if rule == "last":
        return label[starts + timesteps - 1]
    total = np.concatenate([[0], np.cumsum(label)])
    positive = total[starts + timesteps] - total[starts]
    if rule in ("any", "max"):
        return (positive > 0).astype(np.int32)
    return (positive / float(timesteps) >= pos_ratio).astype(np.int32)


def take_frames(tail: tuple, us: np.ndarray, frame: np.ndarray, label: np.ndarray, timesteps: int, step: int, rule: str, pos_ratio: float):
    """(new tail, window rows, late mask) for the new frames of one ID in any order; ``tail`` is
    (frames seen, times, frame ids, labels of the last T - 1 frames)."""
    seen, old_us, old_frame, old_label = tail
    late = us == np.iinfo(np.int64).min  # no time
    if len(old_us):
        late = late | (us < old_us[-1]) | ((us == old_us[-1]) & (frame <= old_frame[-1]))
    order = np.flatnonzero(~late)
    order = order[np.lexsort((frame[order], us[order]))]
    us_, frame_, label_ = (np.concatenate([np.asarray(a, dtype=np.int64), b[order]]) for a, b in ((old_us, us), (old_frame, frame), (old_label, label)))
    first, end = seen - len(old_us), seen + len(order)
    starts = np.arange(max(0, seen - timesteps + 1), end - timesteps + 1)
    starts = starts[starts % step == 0]
    windows = (starts, frame_[starts - first], window_labels(label_, starts - first, timesteps, rule, pos_ratio))
    keep = max(timesteps - 1, 1)
    return (end, us_[-keep:], frame_[-keep:], label_[-keep:]), windows, late


def _micros(df: DataFrame) -> Column:
    """Microseconds of ``ts``; wall-clock times are read as UTC."""
    if df.schema["ts"].dataType.typeName() == "timestamp_ntz":
        return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return F.unix_micros("ts")


def keyed_windows(
    frames: DataFrame, timesteps: int = 10, step: int = 1, rule: str = "any", pos_ratio: float = 0.3, idle_ms: int | None = None, delay: str = "1 hour"
) -> DataFrame:
    """Windows and late frames of a frame stream (ID, ts, frame_id, label): ID, start,
    start_frame_id, y, late (late rows: start null, start_frame_id the frame, y its label)."""
    none = np.iinfo(np.int64).min
    src = frames.filter("ID IS NOT NULL").select(
        F.col("ID").cast("string").alias("ID"), F.coalesce(_micros(frames), F.lit(none)).alias("us"),
        F.col("frame_id").cast("long").alias("frame_id"), F.coalesce(F.col("label").cast("int"), F.lit(0)).alias("label"),
    )
    if idle_ms is not None:
        src = src.withColumn("_event", F.when(F.col("us") != none, F.timestamp_micros("us"))).withWatermark("_event", delay)

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = [(c["us"].to_numpy(), c["frame_id"].to_numpy(), c["label"].to_numpy()) for c in chunks]
        us, frame, label = (np.concatenate([p[i] for p in parts]) for i in range(3))
        tail, (starts, ids, y), late = take_frames(state.get if state.exists else (0, [], [], []), us, frame, label, timesteps, step, rule, pos_ratio)
        state.update((int(tail[0]), *(a.tolist() for a in tail[1:])))
        if idle_ms is not None:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(tail[1][-1]) // 1000 if len(tail[1]) else 0) + idle_ms)
        n = len(starts) + int(late.sum())
        if n:
            begin = pd.array(np.concatenate([starts, np.zeros(n - len(starts), dtype=np.int64)]), dtype="Int64")
            begin[len(starts) :] = pd.NA
            yield pd.DataFrame({
                "ID": key[0], "start": begin, "start_frame_id": np.concatenate([ids, frame[late]]),
                "y": np.concatenate([y, label[late]]).astype("int32"), "late": np.arange(n) >= len(starts),
            })

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout
    return src.groupBy("ID").applyInPandasWithState(run, OUTPUT_SCHEMA, STATE_SCHEMA, "append", timeout)


def start_keyed_windows(windows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the rows of :func:`keyed_windows` to Parquet under ``path``. The state lives in the
    store that the session names, else in RocksDB; its files and the offsets are in ``checkpoint``."""
    spark: SparkSession = windows.sparkSession
    old = spark.conf.get(PROVIDER, None)
    default = old is None or old.endswith("HDFSBackedStateStoreProvider")
    if default:
        spark.conf.set(PROVIDER, ROCKSDB)
    try:
        writer = windows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(**trigger) if trigger else writer).start()
    finally:
        if default:
            spark.conf.unset(PROVIDER) if old is None else spark.conf.set(PROVIDER, old)


def read_keyed_windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OUTPUT_SCHEMA).parquet(path)
