"""Feature scaling, uniform binning and int8 quantization.

Fits are one-row aggregates over the training rows (partial aggregation per task, one
tiny shuffle); the fitted parameters (a few numbers per feature) come to the driver, like
a ``pyspark.ml`` model, and transforms are literal column expressions (stay in codegen).

Mean and variance are the engine's ``avg`` and ``var_pop`` (merged central moments), which
do not cancel for large values or many rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canframes.functions.hashing import shuffle_key
from canframes.schema import FEATURES, INT8_MAX, INT8_MIN, REPRESENTATIVE_ROWS

QMIN, QMAX = INT8_MIN, INT8_MAX


def _long(row_df: DataFrame, features: list[str], cols: list[str]) -> DataFrame:
    """Turn a one-row wide aggregate ``{col}_{feature}`` into (feature, col...) rows."""
    stack = ", ".join(f"'{c}', " + ", ".join(f"`{k}_{c}`" for k in cols) for c in features)
    return row_df.select(F.expr(f"stack({len(features)}, {stack}) AS (feature, {', '.join(cols)})"), *[c for c in row_df.columns if not any(c.startswith(k + "_") for k in cols)])


def scaler_params(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(feature, mean, scale): population std, scale 1 for a zero-variance feature."""
    features = features or FEATURES
    aggs = []
    for c in features:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m_{c}"), F.var_pop(x).alias(f"v_{c}")]
    long = _long(df.agg(*aggs), features, ["m", "v"])
    return long.select("feature", F.col("m").alias("mean"), F.when(F.col("v") > 0, F.sqrt("v")).otherwise(F.lit(1.0)).alias("scale"))


@dataclass(frozen=True)
class Standardizer:
    mean: dict[str, float]
    scale: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, features: list[str] | None = None) -> "Standardizer":
        rows = scaler_params(df, features).collect()  # one row per feature
        return cls({r.feature: r.mean for r in rows}, {r.feature: r.scale for r in rows})

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns(
            {f"{c}{suffix}": (F.col(c).cast("double") - F.lit(self.mean[c])) / F.lit(self.scale[c]) for c in self.mean}
        )

    def inverse(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({f"{c}{suffix}": F.col(c) * F.lit(self.scale[c]) + F.lit(self.mean[c]) for c in self.mean})


def bin_edges(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(feature, min, max) over the rows given (train), all features in one pass."""
    features = features or FEATURES
    aggs = []
    for c in features:
        aggs += [F.min(F.col(c).cast("double")).alias(f"lo_{c}"), F.max(F.col(c).cast("double")).alias(f"hi_{c}")]
    return _long(df.agg(*aggs), features, ["lo", "hi"]).select("feature", F.col("lo").alias("min"), F.col("hi").alias("max"))


def uniform_bin(x: Column, lo: float, hi: float, n_bins: int) -> Column:
    """Ordinal bin of ``x`` among ``n_bins`` equal-width bins over [lo, hi]: right-open
    bins, values outside clipped to the first / last bin, constant feature -> 0."""
    if hi == lo:
        return F.lit(0)
    raw = F.floor((x.cast("double") - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(n_bins))).cast("int")
    return F.least(F.greatest(raw, F.lit(0)), F.lit(n_bins - 1))


@dataclass(frozen=True)
class UniformBinner:
    edges: dict[str, tuple[float, float]]
    n_bins: int

    @classmethod
    def fit(cls, df: DataFrame, n_bins: int, features: list[str] | None = None) -> "UniformBinner":
        rows = bin_edges(df, features).collect()  # one row per feature
        return cls({r.feature: (r["min"], r["max"]) for r in rows}, n_bins)

    def transform(self, df: DataFrame, suffix: str = "_bin") -> DataFrame:
        return df.withColumns({f"{c}{suffix}": uniform_bin(F.col(c), lo, hi, self.n_bins) for c, (lo, hi) in self.edges.items()})


def representative(df: DataFrame, rows: int = REPRESENTATIVE_ROWS, frame_key: str = "frame_id") -> DataFrame:
    """Calibration sample: the first ``rows`` frames in seeded shuffle order (top-k, no sort
    of the whole table)."""
    return df.orderBy(shuffle_key(frame_key), F.col(frame_key)).limit(rows)


def quant_params(sample: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Asymmetric int8 parameters per feature from the calibration range (extended to hold 0):
    scale = (max - min) / 255 (1 when the range is empty), zero point = -128 - round(min / scale)."""
    features = features or FEATURES
    aggs = []
    for c in features:
        aggs += [F.min(F.col(c)).alias(f"lo_{c}"), F.max(F.col(c)).alias(f"hi_{c}")]
    long = _long(sample.agg(*aggs), features, ["lo", "hi"])
    lo = F.least(F.col("lo"), F.lit(0.0))
    hi = F.greatest(F.col("hi"), F.lit(0.0))
    scale = F.when(hi > lo, (hi - lo) / F.lit(float(QMAX - QMIN))).otherwise(F.lit(1.0))
    zp = F.least(F.greatest(F.lit(QMIN) - F.round(lo / scale), F.lit(QMIN)), F.lit(QMAX)).cast("int")
    return long.select("feature", lo.alias("rmin"), hi.alias("rmax"), scale.alias("scale"), zp.alias("zero_point"))


@dataclass(frozen=True)
class Int8Quantizer:
    scale: dict[str, float]
    zero_point: dict[str, int]

    @classmethod
    def fit(cls, sample: DataFrame, features: list[str] | None = None) -> "Int8Quantizer":
        rows = quant_params(sample, features).collect()  # one row per feature
        return cls({r.feature: r.scale for r in rows}, {r.feature: r.zero_point for r in rows})

    def q(self, c: str) -> Column:
        raw = F.round(F.col(c) / F.lit(self.scale[c])) + F.lit(self.zero_point[c])
        return F.least(F.greatest(raw, F.lit(QMIN)), F.lit(QMAX)).cast("int")

    def transform(self, df: DataFrame, suffix: str = "_q") -> DataFrame:
        return df.withColumns({f"{c}{suffix}": self.q(c) for c in self.scale})

    def dequantize(self, c: str, q: Column) -> Column:
        return (q - F.lit(self.zero_point[c])).cast("double") * F.lit(self.scale[c])

    def error_report(self, df: DataFrame) -> DataFrame:
        """Max and mean absolute error of quantize -> dequantize per feature (one pass)."""
        aggs = []
        for c in self.scale:
            err = F.abs(F.col(c) - self.dequantize(c, self.q(c)))
            aggs += [F.max(err).alias(f"mx_{c}"), F.avg(err).alias(f"av_{c}")]
        long = _long(df.agg(*aggs), list(self.scale), ["mx", "av"])
        return long.select("feature", F.col("mx").alias("max_abs_err"), F.col("av").alias("mean_abs_err"))
