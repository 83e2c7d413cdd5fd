"""Queries on wide vectors (the driver's ``embeddings`` table: 64 floats per row): the same
split / scaler / Gaussian NB operators with a 64-name feature list. Target: class 0 vs the
rest; each vector is its own group."""

from __future__ import annotations

from pyspark.sql import functions as F

from canframes.operators import metrics as M
from canframes.operators.naive_bayes import GaussianNB
from canframes.operators.scale import Standardizer
from canframes.operators.split import group_split
from canframes.plans.catalog import register

DIM = 64
WIDE = [f"e_{i}" for i in range(DIM)]


def wide_frames(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(
        "vec_id", F.when(F.col("label") == 0, 1).otherwise(0).alias("label"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(WIDE)]
    )


def _sql() -> str:
    cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {c}" for i, c in enumerate(WIDE))
    base = f"SELECT vec_id, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label, {cols} FROM embeddings"
    split = """SELECT w.*, CASE WHEN r.rn <= r.k THEN 'test' ELSE 'train' END AS split FROM w JOIN (
      SELECT vec_id, row_number() OVER (ORDER BY sha1('42:' || CAST(vec_id AS VARCHAR))) AS rn, CEIL(0.2 * count(*) OVER ()) AS k
      FROM (SELECT DISTINCT vec_id FROM w) d) r USING (vec_id)"""
    mom = "SELECT count(*) AS n, " + ", ".join(f"sum({c}) AS s_{c}, sum({c} * {c}) AS q_{c}" for c in WIDE) + " FROM ws WHERE split = 'train'"
    var = "GREATEST((n * q_{c} - s_{c} * s_{c}) / (n * n), 0)"
    spw = "SELECT " + ", ".join(
        f"s_{c} / n AS m_{c}, CASE WHEN {var.format(c=c)} > 0 THEN sqrt({var.format(c=c)}) ELSE 1 END AS d_{c}" for c in WIDE
    ) + " FROM mom"
    z = "SELECT ws.vec_id, ws.split, ws.label, " + ", ".join(f"(ws.{c} - p.m_{c}) / p.d_{c} AS {c}" for c in WIDE) + " FROM ws, spw p"
    ge = "SELECT GREATEST(" + ", ".join(f"var_pop({c})" for c in WIDE) + ") * 1e-9 AS eps, count(*) AS tot FROM z WHERE split = 'train'"
    gc = "SELECT label, count(*) AS n, " + ", ".join(f"avg({c}) AS mu_{c}, var_pop({c}) AS va_{c}" for c in WIDE) + " FROM z WHERE split = 'train' GROUP BY label"
    gp = "SELECT gc.label, CAST(gc.n AS DOUBLE) / ge.tot AS prior, " + ", ".join(f"mu_{c}, va_{c} + ge.eps AS v_{c}" for c in WIDE) + " FROM gc, ge"
    jl = (
        "SELECT t.vec_id, t.label, g.label AS c, ln(g.prior) - ("
        + " + ".join(f"0.5 * ln(2 * pi() * g.v_{c}) + 0.5 * (t.{c} - g.mu_{c}) * (t.{c} - g.mu_{c}) / g.v_{c}" for c in WIDE)
        + ") AS j FROM z t, gp g WHERE t.split = 'test'"
    )
    d = "(j0 - j1)"
    prob = f"CASE WHEN {d} > 0 THEN exp(-abs({d})) / (1.0 + exp(-abs({d}))) ELSE 1.0 / (1.0 + exp(-abs({d}))) END"
    final = f"""SELECT vec_id, label, round({prob}, 9) AS score FROM (
      SELECT vec_id, label, max(CASE WHEN c = 0 THEN j END) AS j0, max(CASE WHEN c = 1 THEN j END) AS j1 FROM jl GROUP BY vec_id, label) x"""
    ctes = [("w", base), ("ws", split), ("mom", mom), ("spw", spw), ("z", z), ("ge", ge), ("gc", gc), ("gp", gp), ("jl", jl)]
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes) + "\n" + final


@register("wide_gnb_scores", _sql())
def q_wide_gnb_scores(spark, sf_dir):
    """Standardize 64 embedding features on train, Gaussian NB, P(class 0) per test vector."""
    df = group_split(wide_frames(spark, sf_dir), "vec_id")
    train = df.filter(F.col("split") == "train")
    std = Standardizer.fit(train, WIDE)
    z = std.transform(df)
    gnb = GaussianNB.fit(z.filter(F.col("split") == "train"), WIDE)
    out = gnb.transform(z.filter(F.col("split") == "test")).select("vec_id", "label", "score")
    return M.round_doubles(out, 9)
