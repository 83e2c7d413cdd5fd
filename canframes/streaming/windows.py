"""Streaming sliding count-windows per ID as a ``foreachBatch`` sink, in DataFrame operations.

State: the last T - 1 frames of each ID (at least one) with their positions, a Parquet
table written per micro-batch under the output folder. A micro-batch numbers its frames
behind the state (range partitions, so an ID with most of the batch spreads over tasks),
puts the stored tail in front and runs the batch windows on (ID, block) partitions; results
equal the batch windows when frames of an ID arrive in time order across micro-batches. A
frame not later than the last frame already taken for its ID is late: it is left out of the
windows and written as a side-output row (``late`` = true). Frames without an ID belong to no
sequence and are left out. Every batch overwrites its own folders, so a batch that is run again
after a failure leaves the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canframes.operators.positions import with_positions
from canframes.operators.sequence import sequence_windows
from canframes.schema import N_COL, POS_COL
from canframes.session import land

OUTPUT_SCHEMA = "ID string, start long, start_frame_id long, y int, late boolean"


class CountWindows:
    """``foreachBatch`` function; results under ``path/out``, state under ``path/state``."""

    def __init__(self, path: str, timesteps: int = 10, step: int = 1, rule: str = "any", pos_ratio: float = 0.3):
        self.path, self.timesteps, self.step, self.rule, self.pos_ratio = path, timesteps, step, rule, pos_ratio
        self.keep = max(timesteps - 1, 1)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.filter("ID IS NOT NULL").select(F.col("ID").cast("string").alias("ID"), "ts", F.col("frame_id").cast("long"), F.col("label").cast("int"))
        columns = ["ID", POS_COL, "ts", "frame_id", "label"]
        if batch_id:
            tail = spark.read.parquet(f"{self.path}/state/batch={batch_id - 1}").select(columns)
            last = tail.groupBy("ID").agg(F.max_by(F.struct("ts", "frame_id"), POS_COL).alias("_last"), (F.max(POS_COL) + 1).alias("_seen"))
            new = land(new.join(last, "ID", "left"), "stream-batch")
            late = F.col("_last").isNotNull() & (F.struct("ts", "frame_id") <= F.col("_last"))
        else:
            tail, late, new = None, F.lit(False), new.withColumn("_seen", F.lit(None).cast("long"))
        seen = F.coalesce("_seen", F.lit(0))
        rows = with_positions(new.filter(~late), "ID", ["ts", "frame_id"])
        rows = rows.select("ID", (F.col(POS_COL) + seen).alias(POS_COL), "ts", "frame_id", "label", (F.col(N_COL) + seen).alias(N_COL))
        if tail is not None:
            sizes = rows.groupBy("ID").agg(F.max(N_COL).alias(N_COL))
            older = land(tail.join(sizes, "ID", "left").select(*columns, N_COL), "stream-tail")
            rows = rows.unionByName(older)
        windows = sequence_windows(rows.filter(F.col(N_COL).isNotNull()), self.timesteps, self.step, self.rule, self.pos_ratio)
        out = windows.select("ID", "start", "start_frame_id", "y", F.lit(False).alias("late"))
        if tail is not None:
            out = out.unionByName(new.filter(late).select(
                "ID", F.lit(None).cast("long").alias("start"), F.col("frame_id").alias("start_frame_id"), F.col("label").alias("y"), F.lit(True).alias("late")
            ))
        out.write.mode("overwrite").parquet(f"{self.path}/out/batch={batch_id}")
        rest = rows.filter(F.col(N_COL).isNull() | (F.col(POS_COL) >= F.col(N_COL) - self.keep))
        rest.select(columns).write.mode("overwrite").parquet(f"{self.path}/state/batch={batch_id}")


def start_windows(frames: DataFrame, path: str, checkpoint: str, timesteps: int = 10, step: int = 1, rule: str = "any", pos_ratio: float = 0.3, **trigger) -> StreamingQuery:
    """Start the windows of a frame stream (columns ID, ts, frame_id, label); ``trigger`` as
    for ``DataStreamWriter.trigger``. Read the results with :func:`read_windows`."""
    writer = frames.writeStream.foreachBatch(CountWindows(path, timesteps, step, rule, pos_ratio)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_windows(spark, path: str) -> DataFrame:
    """Windows and late frames written so far; late rows have ``start`` null,
    ``start_frame_id`` = the frame and ``y`` = its label."""
    return spark.read.schema(OUTPUT_SCHEMA + ", batch int").parquet(f"{path}/out").drop("batch")
