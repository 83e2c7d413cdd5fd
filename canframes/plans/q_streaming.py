"""Queries: streaming twins of batch operators, run with ``trigger(availableNow=True)``
over the frames written as several time-ordered Parquet files; results are read back
from the Parquet sink."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from canframes.operators.naive_bayes import GaussianNB
from canframes.operators.scale import Standardizer
from canframes.plans.catalog import register
from canframes.plans.fixtures import frames, oracle
from canframes.plans.q_models import _GNB_CTES, _prob_sql
from canframes.plans.q_sequence import POS_SQL, windows_sql
from canframes.plans.q_split import prepared
from canframes.schema import FEATURES
from canframes.session import land, work_path
from canframes.streaming.keyed_windows import keyed_windows, read_keyed_windows, start_keyed_windows
from canframes.streaming.scoring import alert_counts, score_stream, score_stream_with_artifacts
from canframes.streaming.windows import read_windows, start_windows

STREAM_SLICES = 3
ALERT_THRESHOLD = 0.5


def write_stream_input(spark, sf_dir, n_slices: int = STREAM_SLICES) -> tuple[str, int]:
    """The frames as ``n_slices`` time slices appended one after another, so that file times
    follow event time. The frames are scanned once: cut at approximate quantiles of the time
    (a few numbers) and landed by slice; each append reads its slice alone and deals its
    frames evenly over the files. Returns the folder and the files of a slice."""
    f = frames(spark, sf_dir)
    secs = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    cuts = f.agg(F.percentile_approx(secs, [i / n_slices for i in range(1, n_slices)], 10000)).first()[0] or []
    number = F.lit(0)
    for cut in cuts:
        number = number + (secs > F.lit(cut)).cast("int")
    sliced = land(f.withColumn("_slice", number), "stream-slices", ["_slice"])
    sizes = {r["_slice"]: r["count"] for r in sliced.groupBy("_slice").count().collect()}
    # a trigger must read whole slices: the same number of files in each, none of them empty
    per = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), min(sizes.values(), default=1) // 1000))
    out = work_path(spark, "stream-in")
    for i in sorted(sizes):
        before = _files(spark, out)
        sliced.filter(F.col("_slice") == i).drop("_slice").repartition(per).write.mode("append").parquet(out)
        if _files(spark, out) - before != per:
            raise RuntimeError(f"slice {i} was not written as {per} files; a trigger would not read whole slices")
    return out, per


def _files(spark, path: str) -> int:
    try:
        return spark.read.parquet(path).select(F.input_file_name()).distinct().count()
    except AnalysisException:  # nothing written yet
        return 0


def run_to_sink(df, spark, name: str, mode: str = "append"):
    sink, ck = work_path(spark, f"{name}-out"), work_path(spark, f"{name}-ck")
    q = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(sink)


def _stream(spark, sf_dir):
    src, per = write_stream_input(spark, sf_dir)
    schema = frames(spark, sf_dir).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per).parquet(src)


@register(
    "stream_windows",
    oracle(
        "SELECT CAST(ID AS VARCHAR) AS ID, start, start_frame_id, y FROM (" + windows_sql(10, 1, "any") + ") w",
        ["clean"],
        [("fpos", POS_SQL)],
    ),
)
def q_stream_windows(spark, sf_dir):
    """Stateful per-ID count windows over micro-batches = the batch windows (T=10, any)."""
    path, ck = work_path(spark, "stream-windows"), work_path(spark, "stream-windows-ck")
    start_windows(_stream(spark, sf_dir), path, ck, timesteps=10, availableNow=True).awaitTermination()
    out = read_windows(spark, path)
    return out.filter(~F.col("late")).select("ID", "start", "start_frame_id", "y")


@register(
    "stream_keyed_windows",
    oracle(
        "SELECT CAST(ID AS VARCHAR) AS ID, start, start_frame_id, y FROM (" + windows_sql(10, 1, "any") + ") w",
        ["clean"],
        [("fpos", POS_SQL)],
    ),
)
def q_stream_keyed_windows(spark, sf_dir):
    """The same windows from the engine's keyed state (RocksDB), T - 1 frames kept per ID."""
    path, ck = work_path(spark, "keyed-windows"), work_path(spark, "keyed-windows-ck")
    start_keyed_windows(keyed_windows(_stream(spark, sf_dir), timesteps=10), path, ck, availableNow=True).awaitTermination()
    return read_keyed_windows(spark, path).filter(~F.col("late")).select("ID", "start", "start_frame_id", "y")


def _fitted(spark, sf_dir):
    df = prepared(spark, sf_dir)
    train = df.filter(F.col("split") == "train")
    std = Standardizer.fit(train)
    return std, GaussianNB.fit(std.transform(train))


_ALL_JLL = (
    "SELECT t.frame_id, t.ID, g.label AS c, ln(g.prior) - ("
    + " + ".join(f"0.5 * ln(2 * pi() * g.v_{c}) + 0.5 * (t.{c} - g.mu_{c}) * (t.{c} - g.mu_{c}) / g.v_{c}" for c in FEATURES)
    + ") AS j FROM zf t, gp g"
)
_ZF = "SELECT p.frame_id, c.ID, " + ", ".join(f"p.{c}" for c in FEATURES) + " FROM z p JOIN clean c USING (frame_id)"


@register(
    "stream_scores",
    oracle(
        f"""SELECT frame_id, ID, round(s, 9) AS score, CASE WHEN s >= {ALERT_THRESHOLD} THEN 1 ELSE 0 END AS alert FROM (
              SELECT frame_id, ID, {_prob_sql('j0', 'j1')} AS s FROM (
                SELECT frame_id, ID, max(CASE WHEN c = 0 THEN j END) AS j0, max(CASE WHEN c = 1 THEN j END) AS j1
                FROM jla GROUP BY frame_id, ID) x) y""",
        ["prepared"],
        _GNB_CTES + [("zf", _ZF), ("jla", _ALL_JLL)],
    ),
)
def q_stream_scores(spark, sf_dir):
    """Clean -> scale -> Gaussian NB -> alert on the stream, per frame."""
    std, gnb = _fitted(spark, sf_dir)
    scored = score_stream(_stream(spark, sf_dir), std, gnb, ALERT_THRESHOLD)
    out = run_to_sink(scored.select("frame_id", "ID", "score", "alert"), spark, "stream-scores")
    return out.select("frame_id", "ID", F.round("score", 9).alias("score"), "alert")


_SCORED_ALL = f"""SELECT frame_id, CASE WHEN {_prob_sql('j0', 'j1')} >= {ALERT_THRESHOLD} THEN 1 ELSE 0 END AS alert FROM (
  SELECT frame_id, max(CASE WHEN c = 0 THEN j END) AS j0, max(CASE WHEN c = 1 THEN j END) AS j1 FROM jla GROUP BY frame_id) x"""


@register(
    "stream_alert_counts",
    oracle(
        """SELECT window_start_us, window_end_us, n_frames, n_alerts FROM (
             SELECT epoch_us(date_trunc('hour', c.ts)) AS window_start_us,
                    epoch_us(date_trunc('hour', c.ts)) + 3600000000 AS window_end_us,
                    count(*) AS n_frames, CAST(sum(s.alert) AS BIGINT) AS n_alerts
             FROM clean c JOIN sc s USING (frame_id) GROUP BY 1, 2) h
           WHERE window_end_us <= (SELECT epoch_us(max(ts)) FROM clean) - 3600000000""",
        ["prepared"],
        _GNB_CTES + [("zf", _ZF), ("jla", _ALL_JLL), ("sc", _SCORED_ALL)],
    ),
)
def q_stream_alert_counts(spark, sf_dir):
    """Hourly frame / alert counts with a 1-hour watermark (append mode: windows the
    watermark has passed; a frame behind the watermark counts only while its window is in state)."""
    std, gnb = _fitted(spark, sf_dir)
    scored = score_stream(_stream(spark, sf_dir), std, gnb, ALERT_THRESHOLD)
    return run_to_sink(alert_counts(scored), spark, "stream-alerts")


@register("stream_stored_pipeline", oracle("SELECT frame_id, true AS same_score, true AS same_alert FROM clean", ["clean"]))
def q_stream_stored_pipeline(spark, sf_dir):
    """Export, then the saved pipeline over the frame stream: every frame has the score and the
    alert of batch scoring with the stored tables."""
    from canframes.plans.export import export_artifacts, score_frames_with_artifacts
    from canframes.plans.fixtures import clean_view

    art = work_path(spark, "artifacts")
    export_artifacts(spark, sf_dir, art)
    scored = score_stream_with_artifacts(_stream(spark, sf_dir), art)
    out = run_to_sink(scored.select("frame_id", "score", "alert"), spark, "stream-stored")
    batch = score_frames_with_artifacts(clean_view(spark, sf_dir), art).filter(F.col("model") == "logreg").select("frame_id", F.col("score").alias("b"), "pred")
    return out.join(batch, "frame_id", "full").select("frame_id", (F.abs(F.col("score") - F.col("b")) < 1e-12).alias("same_score"), (F.col("alert") == F.col("pred")).alias("same_alert"))
