"""Stream scoring: the batch cleaning, scaling and scoring column functions applied to a
frame stream; alerts counted per tumbling event-time window with a watermark."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canframes.functions.clean import drop_incomplete, read_and_clean
from canframes.functions.thresholds import predict
from canframes.operators.learners import score_column
from canframes.sources import sinks


def score_stream(frames: DataFrame, scaler, model, threshold: float, features: list[str] | None = None) -> DataFrame:
    """Stateless: clean -> standardize -> P(attack) -> alert (score >= threshold).

    ``scaler`` / ``model`` are fitted batch objects whose transforms are literal column
    expressions, so the same code runs on a static or a streaming DataFrame."""
    cleaned = drop_incomplete(read_and_clean(frames, features))
    scored = model.transform(scaler.transform(cleaned))
    return scored.withColumn("alert", predict("score", threshold))


def score_stream_with_artifacts(frames: DataFrame, art_dir: str, features: list[str] | None = None) -> DataFrame:
    """Stateless scoring with what an export wrote: the saved pipeline is loaded once and put
    behind the cleaning, the alert is that of the stored threshold. Frames may be static or
    streaming; a frame that cleaning drops gets no score."""
    threshold = sinks.read_json_row(frames.sparkSession, f"{art_dir}/thresholds.json").first().models["logreg"]["thr_bestF1"]
    cleaned = drop_incomplete(read_and_clean(frames, features))
    scored = score_column(PipelineModel.load(f"{art_dir}/scoring_pipeline").transform(cleaned), "probability")
    return scored.select(*cleaned.columns, "score", predict("score", threshold).alias("alert"))


def alert_counts(scored: DataFrame, window: str = "1 hour", delay: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Frames and alerts per tumbling window; a window is emitted (append mode) once, when
    the watermark (max event time - ``delay``) passes its end. Frames within the delay are
    always counted; a frame behind the watermark counts only while its window is still
    held in state, and is dropped after that."""
    if scored.schema[ts].dataType.typeName() == "timestamp_ntz":
        # wall-clock time read as UTC, independent of the session time zone
        micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
        scored = scored.withColumn("_event", F.timestamp_micros(micros))
    else:
        scored = scored.withColumn("_event", F.col(ts))
    return (
        scored.withWatermark("_event", delay)
        .groupBy(F.window("_event", window).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_frames"), F.sum("alert").cast("long").alias("n_alerts"))
        .select(F.unix_micros("w.start").alias("window_start_us"), F.unix_micros("w.end").alias("window_end_us"), "n_frames", "n_alerts")
    )
