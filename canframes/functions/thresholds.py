"""Threshold predicates and the default-threshold rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canframes.schema import DEFAULT_THRESHOLD, MARGIN_THRESHOLD


def predict(score: str | Column, thr: str | Column | float) -> Column:
    """Prediction is score >= threshold, as 0/1 int."""
    s = F.col(score) if isinstance(score, str) else score
    t = thr if isinstance(thr, Column) else (F.col(thr) if isinstance(thr, str) else F.lit(float(thr)))
    return (s >= t).cast("int")


def default_threshold(min_score: Column, max_score: Column) -> Column:
    """0.0 when scores leave [0, 1] (margins), else 0.5."""
    return F.when((min_score < 0) | (max_score > 1), F.lit(MARGIN_THRESHOLD)).otherwise(F.lit(DEFAULT_THRESHOLD))
