"""Queries: scaler fit / apply / inverse, uniform bins, int8 quantization."""

from __future__ import annotations

from pyspark.sql import functions as F

from canframes.operators import scale as Z
from canframes.operators.metrics import round_doubles
from canframes.plans.catalog import register
from canframes.plans.fixtures import oracle
from canframes.plans.q_split import prepared
from canframes.schema import FEATURES


def _unpivot(src: str, cols: dict[str, str]) -> str:
    """UNION ALL of one row per feature from a one-row table: cols = {out: template}."""
    return " UNION ALL ".join(
        "SELECT '" + c + "' AS feature, " + ", ".join(t.format(c=c) + f" AS {o}" for o, t in cols.items()) + f" FROM {src}" for c in FEATURES
    )


_MOM = "SELECT count(*) AS n, " + ", ".join(
    f"sum(CAST({c} AS DOUBLE)) AS s_{c}, sum(CAST({c} AS DOUBLE) * CAST({c} AS DOUBLE)) AS q_{c}" for c in FEATURES
) + " FROM prepared WHERE split = 'train'"
_VAR = "GREATEST((n * q_{c} - s_{c} * s_{c}) / (n * n), 0)"
_SP = _unpivot("mom", {"mean": "s_{c} / n", "scale": f"CASE WHEN {_VAR} > 0 THEN sqrt({_VAR}) ELSE 1 END"})
_SPW = "SELECT " + ", ".join(
    f"max(CASE WHEN feature = '{c}' THEN mean END) AS m_{c}, max(CASE WHEN feature = '{c}' THEN scale END) AS d_{c}" for c in FEATURES
) + " FROM sp"
_Z = "SELECT p.frame_id, p.split, p.label, " + ", ".join(f"(CAST(p.{c} AS DOUBLE) - w.m_{c}) / w.d_{c} AS {c}" for c in FEATURES) + " FROM prepared p, spw w"
SCALE_CTES = [("mom", _MOM), ("sp", _SP), ("spw", _SPW), ("z", _Z)]


def standardized(spark, sf_dir):
    df = prepared(spark, sf_dir)
    std = Z.Standardizer.fit(df.filter(F.col("split") == "train"))
    return std.transform(df), std


@register("scaler_params", oracle("SELECT feature, round(mean, 6) AS mean, round(scale, 6) AS scale FROM sp", ["prepared"], SCALE_CTES[:2]))
def q_scaler_params(spark, sf_dir):
    return round_doubles(Z.scaler_params(prepared(spark, sf_dir).filter(F.col("split") == "train")), 6)


@register(
    "scaled_frames",
    oracle("SELECT frame_id, split, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + " FROM z", ["prepared"], SCALE_CTES),
)
def q_scaled_frames(spark, sf_dir):
    z, _ = standardized(spark, sf_dir)
    return round_doubles(z.select("frame_id", "split", *FEATURES), 6)


@register(
    "inverse_scaled",
    oracle(
        "SELECT z.frame_id, " + ", ".join(f"round(z.{c} * w.d_{c} + w.m_{c}, 6) AS {c}" for c in FEATURES) + " FROM z, spw w",
        ["prepared"],
        SCALE_CTES,
    ),
)
def q_inverse_scaled(spark, sf_dir):
    z, std = standardized(spark, sf_dir)
    return round_doubles(std.inverse(z.select("frame_id", *FEATURES)), 6)


_EDGES = "SELECT " + ", ".join(f"min(CAST({c} AS DOUBLE)) AS lo_{c}, max(CAST({c} AS DOUBLE)) AS hi_{c}" for c in FEATURES) + " FROM prepared WHERE split = 'train'"


@register("bin_edges", oracle(_unpivot("ed", {"min": "lo_{c}", "max": "hi_{c}"}), ["prepared"], [("ed", _EDGES)]))
def q_bin_edges(spark, sf_dir):
    return Z.bin_edges(prepared(spark, sf_dir).filter(F.col("split") == "train"))


def bins_cte(n: int) -> str:
    """SELECT of frame_id, split, label and the n-bin ordinal of each feature (needs ``ed``)."""
    cols = ", ".join(
        f"CASE WHEN e.hi_{c} = e.lo_{c} THEN 0 ELSE LEAST(GREATEST(CAST(FLOOR((CAST(p.{c} AS DOUBLE) - e.lo_{c}) / (e.hi_{c} - e.lo_{c}) * {float(n)}) AS INT), 0), {n - 1}) END AS {c}_bin"
        for c in FEATURES
    )
    return f"SELECT p.frame_id, p.split, p.label, {cols} FROM prepared p, ed e"


EDGES_CTE = ("ed", _EDGES)


def _bins_sql(n: int) -> str:
    return oracle("SELECT frame_id, " + ", ".join(f"{c}_bin" for c in FEATURES) + " FROM b", ["prepared"], [EDGES_CTE, ("b", bins_cte(n))])


def _binned(spark, sf_dir, n):
    df = prepared(spark, sf_dir)
    b = Z.UniformBinner.fit(df.filter(F.col("split") == "train"), n)
    return b.transform(df).select("frame_id", *[f"{c}_bin" for c in FEATURES])


@register("binned_16", _bins_sql(16))
def q_binned_16(spark, sf_dir):
    return _binned(spark, sf_dir, 16)


@register("binned_2", _bins_sql(2))
def q_binned_2(spark, sf_dir):
    return _binned(spark, sf_dir, 2)


_REP = "SELECT * FROM z WHERE split = 'train' ORDER BY sha1('42:' || CAST(frame_id AS VARCHAR)), frame_id LIMIT 1000"
_QR = "SELECT " + ", ".join(f"LEAST(min({c}), 0) AS lo_{c}, GREATEST(max({c}), 0) AS hi_{c}" for c in FEATURES) + " FROM rep"
_QP = _unpivot(
    "qr",
    {
        "rmin": "lo_{c}",
        "rmax": "hi_{c}",
        "scale": "CASE WHEN hi_{c} > lo_{c} THEN (hi_{c} - lo_{c}) / 255.0 ELSE 1.0 END",
    },
)
_QP2 = "SELECT feature, rmin, rmax, scale, CAST(LEAST(GREATEST(-128 - round(rmin / scale), -128), 127) AS INT) AS zero_point FROM qp0"
_QPW = "SELECT " + ", ".join(
    f"max(CASE WHEN feature = '{c}' THEN scale END) AS sc_{c}, max(CASE WHEN feature = '{c}' THEN zero_point END) AS zp_{c}" for c in FEATURES
) + " FROM qp"
QUANT_CTES = SCALE_CTES + [("rep", _REP), ("qr", _QR), ("qp0", _QP), ("qp", _QP2), ("qpw", _QPW)]


def _q_sql(c: str) -> str:
    return f"CAST(LEAST(GREATEST(round(z.{c} / w.sc_{c}) + w.zp_{c}, -128), 127) AS INT)"


def quantizer(spark, sf_dir):
    z, _ = standardized(spark, sf_dir)
    return z, Z.Int8Quantizer.fit(Z.representative(z.filter(F.col("split") == "train")))


@register(
    "quant_params",
    oracle("SELECT feature, round(rmin, 9) AS rmin, round(rmax, 9) AS rmax, round(scale, 9) AS scale, zero_point FROM qp", ["prepared"], QUANT_CTES),
)
def q_quant_params(spark, sf_dir):
    z, _ = standardized(spark, sf_dir)
    return round_doubles(Z.quant_params(Z.representative(z.filter(F.col("split") == "train"))), 9)


@register(
    "quantized",
    oracle("SELECT z.frame_id, " + ", ".join(f"{_q_sql(c)} AS {c}_q" for c in FEATURES) + " FROM z, qpw w WHERE z.split = 'test'", ["prepared"], QUANT_CTES),
)
def q_quantized(spark, sf_dir):
    z, qz = quantizer(spark, sf_dir)
    return qz.transform(z.filter(F.col("split") == "test")).select("frame_id", *[f"{c}_q" for c in FEATURES])


_ERR = "SELECT " + ", ".join(
    f"max(abs(z.{c} - CAST({_q_sql(c)} - w.zp_{c} AS DOUBLE) * w.sc_{c})) AS mx_{c}, avg(abs(z.{c} - CAST({_q_sql(c)} - w.zp_{c} AS DOUBLE) * w.sc_{c})) AS av_{c}"
    for c in FEATURES
) + " FROM z, qpw w WHERE z.split = 'test'"


@register(
    "quant_error",
    oracle(
        "SELECT feature, round(max_abs_err, 6) AS max_abs_err, round(mean_abs_err, 6) AS mean_abs_err FROM ("
        + _unpivot("er", {"max_abs_err": "mx_{c}", "mean_abs_err": "av_{c}"})
        + ") u",
        ["prepared"],
        QUANT_CTES + [("er", _ERR)],
    ),
)
def q_quant_error(spark, sf_dir):
    z, qz = quantizer(spark, sf_dir)
    return round_doubles(qz.error_report(z.filter(F.col("split") == "test")), 6)
