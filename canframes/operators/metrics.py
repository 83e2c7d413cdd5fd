"""Threshold metrics, ROC / PR curves, AUC, AP and best-F1 tuning for a long score table
``(model, label, score)``.

Everything is derived from one score-grouped table ``(model, score, p, n)`` (partial
aggregation before the shuffle, ties collapsed) and its cumulative counts in descending
score order:

1. the table is range-partitioned on (model, score) and landed, so the raw scores are read
   once and no single task orders all distinct scores of a model,
2. totals per (model, partition) give offsets (models x partitions rows, broadcast behind a
   size check),
3. a running sum inside each (model, partition) is added to the offset.

The point index ``idx`` (1-based rank of the distinct score) comes from the landed places,
and the counts of the next point (for ROC point dropping) from the same window, over the
edge of a partition from the offsets: no self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canframes.functions.thresholds import default_threshold
from canframes.operators.positions import join_same, ranged
from canframes.schema import F1_EPS_EVAL, F1_EPS_TUNE
from canframes.session import land



def _div(a: Column, b: Column) -> Column:
    """a / b as double, 0 when b == 0 (zero-division rule of the metrics)."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def score_counts(scores: DataFrame, model: str = "model", score: str = "score", label: str = "label") -> DataFrame:
    """``(model, score, p, n)``: positives / negatives per distinct score."""
    lab = F.col(label).cast("long")
    return scores.groupBy(model, score).agg(
        F.sum(lab).alias("p"), F.sum(F.lit(1) - lab).alias("n")
    ).withColumnRenamed(model, "model").withColumnRenamed(score, "score")


def cumulative_counts(counts: DataFrame, parts: int | None = None) -> DataFrame:
    """Add ``tp``/``fp`` (counts with score >= this score), ``idx`` (1-based point number in
    descending score order), totals ``tot_p``/``tot_n``, ``m`` (points of the model) and ``next``
    (``p`` and ``n`` of the next lower score, null at the last point)."""
    g = ranged(counts, [F.col("model").asc_nulls_last(), F.col("score").desc()], parts)
    totals = g.groupBy("model", "_pid").agg(
        F.sum("p").alias("_sp"), F.sum("n").alias("_sn"), F.count(F.lit(1)).alias("_sc"), F.min("_mid").alias("_m0"),
        F.min_by(F.struct("p", "n"), "_mid").alias("_first"),
    )
    after = Window.partitionBy("model").orderBy("_pid")
    before = Window.partitionBy("model").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("model")
    offsets = land(
        totals.select(
            "model",
            "_pid",
            "_m0",
            F.coalesce(F.sum("_sp").over(before), F.lit(0)).alias("_op"),
            F.coalesce(F.sum("_sn").over(before), F.lit(0)).alias("_on"),
            F.coalesce(F.sum("_sc").over(before), F.lit(0)).alias("_oc"),
            F.sum("_sp").over(whole).alias("tot_p"),
            F.sum("_sn").over(whole).alias("tot_n"),
            F.sum("_sc").over(whole).alias("m"),
            F.lead("_first").over(after).alias("_over"),
        ),
        "curve-offsets",
    )
    run = Window.partitionBy("model", "_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    local = g.select(
        "model", "_pid", "_mid", "score", "p", "n", F.sum("p").over(run).alias("_lp"), F.sum("n").over(run).alias("_ln"),
        F.lead(F.struct("p", "n")).over(Window.partitionBy("model", "_pid").orderBy("_mid")).alias("_next"),
    )
    joined = join_same(local, offsets, ["model", "_pid"], offsets.count(), 128)
    return joined.select(
        "model",
        "score",
        "p",
        "n",
        (F.col("_op") + F.col("_lp")).alias("tp"),
        (F.col("_on") + F.col("_ln")).alias("fp"),
        (F.col("_oc") + F.col("_mid") - F.col("_m0") + 1).alias("idx"),
        "tot_p",
        "tot_n",
        "m",
        F.coalesce("_next", "_over").alias("next"),
    )


def curve(scores: DataFrame, parts: int | None = None, **cols) -> DataFrame:
    """Cumulative counts per distinct score. The score-grouped table (one row per distinct
    score, far smaller than the scores) is landed in score order first, so the raw scores
    are scanned once however many branches the reports build on it."""
    return cumulative_counts(score_counts(scores, **cols), parts)


def shared_curve(scores: DataFrame, parts: int | None = None, **cols) -> DataFrame:
    """The curve landed as well, for reports that read it several times (the running sums
    are then computed once)."""
    return land(curve(scores, parts, **cols), "curve")


def rule_from_curve(cum: DataFrame) -> DataFrame:
    """Default-threshold rule per model from the curve's distinct scores (no raw rescan)."""
    return cum.groupBy("model").agg(F.min("score").alias("min_score"), F.max("score").alias("max_score")).withColumn(
        "thr_default", default_threshold(F.col("min_score"), F.col("max_score"))
    )


def threshold_rule(scores: DataFrame, model: str = "model", score: str = "score") -> DataFrame:
    """Per model: min and max score and the default threshold (0.0 for margins, else 0.5)."""
    return scores.groupBy(F.col(model).alias("model")).agg(
        F.min(score).alias("min_score"), F.max(score).alias("max_score")
    ).withColumn("thr_default", default_threshold(F.col("min_score"), F.col("max_score")))


def _rates(tp: Column, fp: Column, P: Column, N: Column, prefix: str = "") -> list[Column]:
    fn = P - tp
    tn = N - fp
    return [
        _div(tp + tn, P + N).alias(f"acc{prefix}"),
        _div(tp, tp + fp).alias(f"prec{prefix}"),
        _div(tp, P).alias(f"rec{prefix}"),
        _div(2 * tp, 2 * tp + fp + fn).alias(f"f1{prefix}"),
    ]


def auc_and_totals(cum: DataFrame) -> DataFrame:
    """Exact ROC-AUC (ties count one half) per model; NaN when one class is absent."""
    return cum.groupBy("model").agg(
        F.first("tot_p").alias("tot_p"),
        F.first("tot_n").alias("tot_n"),
        F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)).alias("_u"),
    ).select(
        "model",
        "tot_p",
        "tot_n",
        F.when((F.col("tot_p") > 0) & (F.col("tot_n") > 0), F.col("_u") / (F.col("tot_p") * F.col("tot_n"))).otherwise(F.lit(float("nan"))).alias("auc"),
    )


def counts_at(cum: DataFrame, thresholds: DataFrame, thr_col: str = "thr") -> DataFrame:
    """Confusion counts per model at a per-model threshold (pred = score >= thr).

    ``thresholds`` has one row per model, so the join is a bounded broadcast."""
    j = cum.join(F.broadcast(thresholds.select("model", thr_col)), "model")
    hit = F.col("score") >= F.col(thr_col)
    return j.groupBy("model", thr_col).agg(
        F.coalesce(F.max(F.when(hit, F.col("tp"))), F.lit(0)).alias("tp"),
        F.coalesce(F.max(F.when(hit, F.col("fp"))), F.lit(0)).alias("fp"),
        F.first("tot_p").alias("tot_p"),
        F.first("tot_n").alias("tot_n"),
    )


def confusion(scores: DataFrame, thresholds: DataFrame | None = None, thr_col: str = "thr_default") -> DataFrame:
    """tn, fp, fn, tp per model at the default-rule threshold (or the given ones), read off
    the score curve: the raw scores are scanned once."""
    cum = shared_curve(scores)
    if thresholds is None:
        thresholds = rule_from_curve(cum).select("model", thr_col)
    at = counts_at(cum, thresholds, thr_col)
    return at.select(
        "model",
        (F.col("tot_n") - F.col("fp")).alias("tn"),
        F.col("fp").cast("long").alias("fp"),
        (F.col("tot_p") - F.col("tp")).alias("fn"),
        F.col("tp").cast("long").alias("tp"),
    )


def metrics_report(scores: DataFrame, thresholds: DataFrame | None = None, thr_col: str = "thr", parts: int | None = None) -> DataFrame:
    """acc / prec / rec / f1 at the threshold (default rule unless given) and AUC, per model."""
    cum = shared_curve(scores, parts)
    if thresholds is None:
        thresholds = rule_from_curve(cum).select("model", F.col("thr_default").alias(thr_col))
    at = counts_at(cum, thresholds, thr_col)
    auc = auc_and_totals(cum).select("model", "auc")
    tp, fp, P, N = (F.col(c) for c in ("tp", "fp", "tot_p", "tot_n"))
    return at.join(auc, "model").select("model", F.col(thr_col).alias("thr"), *_rates(tp, fp, P, N), "auc")


def roc_curve(cum: DataFrame, drop_intermediate: bool = True) -> DataFrame:
    """ROC points ``(model, threshold, fpr, tpr)`` plus the (0, 0, +inf) start point.

    A point is dropped when the steps before and after it are equal in both fp and tp, first
    and last points kept, only when a model has more than two points. The steps are the
    counts of the point and of the next one."""
    base = cum
    if drop_intermediate:
        interior = (F.col("idx") > 1) & (F.col("idx") < F.col("m"))
        flat = (F.col("p") == F.col("next.p")) & (F.col("n") == F.col("next.n"))
        base = cum.filter(~(interior & F.coalesce(flat, F.lit(False))))
    pts = base.select(
        "model",
        F.col("score").alias("threshold"),
        F.when(F.col("tot_n") > 0, F.col("fp") / F.col("tot_n")).otherwise(F.lit(float("nan"))).alias("fpr"),
        F.when(F.col("tot_p") > 0, F.col("tp") / F.col("tot_p")).otherwise(F.lit(float("nan"))).alias("tpr"),
    )
    start = cum.select("model").distinct().select(
        "model", F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return pts.unionByName(start)


def pr_curve(cum: DataFrame) -> DataFrame:
    """Precision-recall points ``(model, threshold, precision, recall)`` for every distinct
    score, plus the final (precision 1, recall 0) point with a null threshold."""
    pts = cum.select(
        "model",
        F.col("score").alias("threshold"),
        _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.when(F.col("tot_p") > 0, F.col("tp") / F.col("tot_p")).otherwise(F.lit(1.0)).alias("recall"),
    )
    end = cum.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return pts.unionByName(end)


def average_precision(cum: DataFrame) -> DataFrame:
    """AP = sum over points of (recall step) * precision = sum p_k / P * precision_k."""
    prec = _div(F.col("tp"), F.col("tp") + F.col("fp"))
    return cum.groupBy("model").agg(
        F.coalesce(F.sum(F.try_divide(F.col("p").cast("double"), F.col("tot_p").cast("double")) * prec), F.lit(0.0)).alias("ap")
    )


def _best(cum: DataFrame, eps: float) -> DataFrame:
    """Highest F1 = 2PR/(P+R+eps) over the curve points; ties -> lowest threshold."""
    prec = _div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = F.when(F.col("tot_p") > 0, F.col("tp") / F.col("tot_p")).otherwise(F.lit(1.0))
    f1 = F.lit(2.0) * F.col("_pr") * F.col("_rc") / (F.col("_pr") + F.col("_rc") + F.lit(eps))
    pts = cum.select("model", "score", "tp", "fp", "tot_p", "tot_n", prec.alias("_pr"), rec.alias("_rc")).withColumn("_f1", f1)
    best = pts.groupBy("model").agg(
        F.max(F.struct(F.col("_f1"), (-F.col("score")).alias("_negthr"), "_pr", "_rc", "tp", "fp", "tot_p", "tot_n")).alias("b")
    )
    return best.select(
        "model",
        (-F.col("b._negthr")).alias("threshold"),
        F.col("b._pr").alias("precision"),
        F.col("b._rc").alias("recall"),
        F.col("b._f1").alias("f1"),
        F.col("b.tp").alias("tp"),
        F.col("b.fp").alias("fp"),
        F.col("b.tot_p").alias("tot_p"),
        F.col("b.tot_n").alias("tot_n"),
    )


def best_threshold_by_f1(cum: DataFrame) -> DataFrame:
    """Best-F1 threshold (eps 1e-9), with precision / recall / F1 at it, per model."""
    return _best(cum, F1_EPS_TUNE).select("model", "threshold", "precision", "recall", "f1")


def tune_and_report(scores: DataFrame, parts: int | None = None) -> DataFrame:
    """Tune the threshold by F1, then report metrics at it (the counts come from the curve)."""
    cum = shared_curve(scores, parts)
    best = _best(cum, F1_EPS_TUNE)
    auc = auc_and_totals(cum).select("model", "auc")
    tp, fp, P, N = (F.col(c) for c in ("tp", "fp", "tot_p", "tot_n"))
    return best.join(auc, "model").select("model", F.col("threshold").alias("thr"), *_rates(tp, fp, P, N), "auc")


def eval_with_thresholds(scores: DataFrame, thr: float | None = 0.5, parts: int | None = None, tune: DataFrame | None = None) -> DataFrame:
    """Default-threshold and best-F1 report, 13 fields per model, from one curve.

    With ``tune`` (scores of a validation split) the best-F1 threshold is chosen there and
    the ``_b`` metrics are those of ``scores`` at that threshold."""
    cum = shared_curve(scores, parts)
    if thr is None:
        thresholds = rule_from_curve(cum).select("model", F.col("thr_default").alias("thr"))
    else:
        thresholds = cum.select("model").distinct().withColumn("thr", F.lit(float(thr)))
    at = counts_at(cum, thresholds, "thr")
    auc = auc_and_totals(cum).select("model", "auc")
    tp, fp, P, N = (F.col(c) for c in ("tp", "fp", "tot_p", "tot_n"))
    d = at.select("model", F.col("thr").alias("thr_default"), *_rates(tp, fp, P, N))
    if tune is None:
        best = _best(cum, F1_EPS_EVAL)
        b = best.select("model", F.col("threshold").alias("thr_bestF1"), *_rates(tp, fp, P, N, "_b"), F.col("f1").alias("bestF1"))
    else:
        tuned = _best(shared_curve(tune, parts), F1_EPS_EVAL).select("model", F.col("threshold").alias("thr_bestF1"), F.col("f1").alias("bestF1"))
        at_b = counts_at(cum, tuned.select("model", F.col("thr_bestF1")), "thr_bestF1")
        b = at_b.join(tuned.select("model", "bestF1"), "model").select("model", "thr_bestF1", *_rates(tp, fp, P, N, "_b"), "bestF1")
    return d.join(auc, "model").join(b, "model")


METRICS_TABLE_COLUMNS = [
    "model", "thr_default", "acc", "prec", "rec", "f1", "auc",
    "thr_bestF1", "acc_bestF1", "prec_bestF1", "rec_bestF1", "f1_bestF1",
]


def metrics_table(evaluated: DataFrame) -> DataFrame:
    """The 12-column metrics table (one row per model) from ``eval_with_thresholds``."""
    return evaluated.select(
        "model", "thr_default", "acc", "prec", "rec", "f1", "auc", "thr_bestF1",
        F.col("acc_b").alias("acc_bestF1"), F.col("prec_b").alias("prec_bestF1"),
        F.col("rec_b").alias("rec_bestF1"), F.col("f1_b").alias("f1_bestF1"),
    )


def round_doubles(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double column (compared output only; curves keep exact values)."""
    return df.select(
        *[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields]
    )
