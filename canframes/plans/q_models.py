"""Queries: majority baseline, Naive Bayes variants (closed form, SQL-checked), and the
``pyspark.ml`` learners (metric rows; rows-only check plus own tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from canframes.operators import metrics as M
from canframes.operators import naive_bayes as NB
from canframes.operators.learners import coefficient_table, fit_and_score, importance_table
from canframes.operators.scale import UniformBinner
from canframes.plans.catalog import register
from canframes.plans.fixtures import oracle
from canframes.plans.q_scale import EDGES_CTE, SCALE_CTES, bins_cte, standardized
from canframes.plans.q_split import prepared
from canframes.plans.train_evaluate import LEARNERS
from canframes.schema import BERNOULLI_NB_BINS, COMPLEMENT_NB_BINS, FEATURES
from canframes.session import land


def _prob_sql(j0: str, j1: str) -> str:
    d = f"({j0} - {j1})"
    e = f"exp(-abs({d}))"
    return f"CASE WHEN {d} > 0 THEN {e} / (1.0 + {e}) ELSE 1.0 / (1.0 + {e}) END"


def _scores_from_jll(src: str) -> str:
    """Final SELECT: P(class 1) per test frame from a (frame_id, label, c, j) table."""
    return f"""SELECT frame_id, label, round({_prob_sql('j0', 'j1')}, 9) AS score FROM (
      SELECT frame_id, label, max(CASE WHEN c = 0 THEN j END) AS j0, max(CASE WHEN c = 1 THEN j END) AS j1
      FROM {src} GROUP BY frame_id, label) x"""


# --- majority baseline -------------------------------------------------------------------

@register(
    "dummy_scores",
    oracle(
        """SELECT p.frame_id, p.label, CAST(m.label AS DOUBLE) AS score, m.label AS pred FROM prepared p,
           (SELECT label FROM prepared WHERE split = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) m
           WHERE p.split = 'test'""",
        ["prepared"],
    ),
)
def q_dummy_scores(spark, sf_dir):
    df = prepared(spark, sf_dir)
    m = NB.Majority.fit(df.filter(F.col("split") == "train"))
    return m.transform(df.filter(F.col("split") == "test")).select("frame_id", "label", "score", "pred")


# --- Gaussian NB on standardized features ---------------------------------------------------

_GNB_CTES = SCALE_CTES + [
    ("tr", "SELECT * FROM z WHERE split = 'train'"),
    ("ge", "SELECT GREATEST(" + ", ".join(f"var_pop({c})" for c in FEATURES) + ") * 1e-9 AS eps, count(*) AS tot FROM tr"),
    (
        "gc",
        "SELECT label, count(*) AS n, " + ", ".join(f"avg({c}) AS mu_{c}, var_pop({c}) AS va_{c}" for c in FEATURES) + " FROM tr GROUP BY label",
    ),
    (
        "gp",
        "SELECT gc.label, gc.n, CAST(gc.n AS DOUBLE) / ge.tot AS prior, "
        + ", ".join(f"mu_{c}, va_{c} + ge.eps AS v_{c}" for c in FEATURES)
        + " FROM gc, ge",
    ),
]


@register(
    "gnb_params",
    oracle(
        "SELECT label, feature, n, round(prior, 9) AS prior, round(mean, 9) AS mean, round(var, 9) AS var FROM ("
        + " UNION ALL ".join(f"SELECT label, '{c}' AS feature, n, prior, mu_{c} AS mean, v_{c} AS var FROM gp" for c in FEATURES)
        + ") u",
        ["prepared"],
        _GNB_CTES,
    ),
)
def q_gnb_params(spark, sf_dir):
    z, _ = standardized(spark, sf_dir)
    return M.round_doubles(NB.gnb_params(z.filter(F.col("split") == "train")), 9)


_GNB_JLL = (
    "SELECT t.frame_id, t.label, g.label AS c, ln(g.prior) - ("
    + " + ".join(f"0.5 * ln(2 * pi() * g.v_{c}) + 0.5 * (t.{c} - g.mu_{c}) * (t.{c} - g.mu_{c}) / g.v_{c}" for c in FEATURES)
    + ") AS j FROM z t, gp g WHERE t.split = 'test'"
)


@register("gnb_scores", oracle(_scores_from_jll("jl"), ["prepared"], _GNB_CTES + [("jl", _GNB_JLL)]))
def q_gnb_scores(spark, sf_dir):
    z, _ = standardized(spark, sf_dir)
    m = NB.GaussianNB.fit(z.filter(F.col("split") == "train"))
    return M.round_doubles(m.transform(z.filter(F.col("split") == "test")).select("frame_id", "label", "score"), 9)


# --- Complement NB on 16 ordinal bins -------------------------------------------------------

BIN16 = [f"{c}_bin" for c in FEATURES]
_CNB_CTES = [
    EDGES_CTE,
    ("b", bins_cte(COMPLEMENT_NB_BINS)),
    ("fc", "SELECT label, " + ", ".join(f"CAST(sum({b}) AS DOUBLE) AS f_{b}" for b in BIN16) + " FROM b WHERE split = 'train' GROUP BY label"),
    ("fa", "SELECT " + ", ".join(f"sum(f_{b}) AS a_{b}" for b in BIN16) + " FROM fc"),
    ("cc", "SELECT label, " + ", ".join(f"a_{b} - f_{b} + 1.0 AS c_{b}" for b in BIN16) + " FROM fc, fa"),
    ("fl", "SELECT label, " + ", ".join(f"-ln(c_{b} / (" + " + ".join(f"c_{x}" for x in BIN16) + f")) AS w_{b}" for b in BIN16) + " FROM cc"),
    ("jl", "SELECT b.frame_id, b.label, f.label AS c, " + " + ".join(f"b.{x} * f.w_{x}" for x in BIN16) + " AS j FROM b, fl f WHERE b.split = 'test'"),
]


def _binned_split(spark, sf_dir, n):
    df = prepared(spark, sf_dir)
    b = UniformBinner.fit(df.filter(F.col("split") == "train"), n)
    return b.transform(df)


@register("cnb_scores", oracle(_scores_from_jll("jl"), ["prepared"], _CNB_CTES))
def q_cnb_scores(spark, sf_dir):
    df = _binned_split(spark, sf_dir, COMPLEMENT_NB_BINS)
    m = NB.ComplementNB.fit(df.filter(F.col("split") == "train"), BIN16)
    return M.round_doubles(m.transform(df.filter(F.col("split") == "test")).select("frame_id", "label", "score"), 9)


# --- Bernoulli NB on 2 bins ---------------------------------------------------------------------

_BNB_CTES = [
    EDGES_CTE,
    ("b", bins_cte(BERNOULLI_NB_BINS)),
    ("bc", "SELECT label, count(*) AS n, " + ", ".join(f"sum(CASE WHEN {x} > 0 THEN 1 ELSE 0 END) AS f_{x}" for x in BIN16) + " FROM b WHERE split = 'train' GROUP BY label"),
    ("bp", "SELECT label, ln(CAST(n AS DOUBLE) / t.tot) AS lp, " + ", ".join(f"ln(f_{x} + 1.0) - ln(n + 2.0) AS l_{x}" for x in BIN16) + " FROM bc, (SELECT sum(n) AS tot FROM bc) t"),
    ("bq", "SELECT *, " + ", ".join(f"ln(1 - exp(l_{x})) AS g_{x}" for x in BIN16) + " FROM bp"),
    (
        "jl",
        "SELECT b.frame_id, b.label, q.label AS c, q.lp + ("
        + " + ".join(f"q.g_{x}" for x in BIN16)
        + ") + "
        + " + ".join(f"(CASE WHEN b.{x} > 0 THEN 1.0 ELSE 0.0 END) * (q.l_{x} - q.g_{x})" for x in BIN16)
        + " AS j FROM b, bq q WHERE b.split = 'test'",
    ),
]


@register("bnb_scores", oracle(_scores_from_jll("jl"), ["prepared"], _BNB_CTES))
def q_bnb_scores(spark, sf_dir):
    df = _binned_split(spark, sf_dir, BERNOULLI_NB_BINS)
    m = NB.BernoulliNB.fit(df.filter(F.col("split") == "train"), BIN16)
    return M.round_doubles(m.transform(df.filter(F.col("split") == "test")).select("frame_id", "label", "score"), 9)


# --- pyspark.ml learners: one metrics row per model (rows-only check) ------------------------

def learner_scores(spark, sf_dir, name):
    z, _ = standardized(spark, sf_dir)
    model, scored = fit_and_score(name, z.filter(F.col("split") == "train"), z.filter(F.col("split") == "test"))
    return model, scored.select(F.lit(LEARNERS[name]).alias("model"), "frame_id", "label", "score")


def _register_learner(name: str):
    @register(f"{name}_metrics")
    def q(spark, sf_dir):
        _, s = learner_scores(spark, sf_dir, name)
        return M.round_doubles(M.metrics_table(M.eval_with_thresholds(s, thr=None)))

    q.__name__ = f"q_{name}_metrics"
    return q


for _n in LEARNERS:
    _register_learner(_n)


@register("coef_table")
def q_coef_table(spark, sf_dir):
    model, _ = learner_scores(spark, sf_dir, "logreg")
    return coefficient_table(model, spark=spark)


@register("importance_table")
def q_importance_table(spark, sf_dir):
    model, _ = learner_scores(spark, sf_dir, "forest")
    return importance_table(model, spark=spark)


# --- online learners by parameter mixing, sequence classifiers (rows-only) ---------------------

def _online_metrics(spark, sf_dir, kind: str, label: str):
    from canframes.operators.online import decision_function, fit_online

    z, _ = standardized(spark, sf_dir)
    w = fit_online(z.filter(F.col("split") == "train"), kind=kind)
    test = decision_function(z.filter(F.col("split") == "test"), w)
    scored = test.select(F.lit(label).alias("model"), "frame_id", "label", "score")
    return M.round_doubles(M.metrics_table(M.eval_with_thresholds(scored, thr=None)))


@register("perceptron_metrics")
def q_perceptron_metrics(spark, sf_dir):
    return _online_metrics(spark, sf_dir, "perceptron", "Perceptron(balanced)")


@register("passive_aggressive_metrics")
def q_passive_aggressive_metrics(spark, sf_dir):
    return _online_metrics(spark, sf_dir, "pa", "PassiveAggressive(balanced)")


@register("sgd_decay_metrics")
def q_sgd_decay_metrics(spark, sf_dir):
    """Hinge descent with the decaying step, stopped by the tolerance."""
    return _online_metrics(spark, sf_dir, "sgd_hinge", "SGD-hinge(decaying step)")


@register(
    "online_stops",
    "SELECT k.kind, true AS settled, true AS loss_fell FROM (VALUES ('perceptron'), ('pa'), ('sgd_hinge')) k(kind)",
)
def q_online_stops(spark, sf_dir):
    """Every online learner stops by its tolerance before the epoch limit, with a lower loss than
    that of the first epoch."""
    from canframes.operators.online import run_online

    z, _ = standardized(spark, sf_dir)
    train = land(z.filter(F.col("split") == "train"), "online-train")
    rows = []
    for kind in ("perceptron", "pa", "sgd_hinge"):
        fit = run_online(train, kind, epochs=200)
        rows.append((kind, fit.settled, bool(min(fit.losses) <= fit.losses[0])))
    return spark.createDataFrame(rows, "kind string, settled boolean, loss_fell boolean")


def _seq_metrics(spark, sf_dir, improved: bool, boosted: bool = False):
    from canframes.operators import sequence as Q
    from canframes.operators.seq_models import fit_sequence_gbt, fit_sequence_mlp, sequence_chunks
    from canframes.plans.q_sequence import framed

    fp = framed(spark, sf_dir)
    if improved:
        fp = land(Q.add_sequence_context(fp), "context")
        data = sequence_chunks(fp, Q.context_features(), timesteps=20, label_rule="ratio", pos_ratio=0.3, with_id=True)
        name = "(seq+ID)"
    else:
        data = sequence_chunks(fp, FEATURES, timesteps=10, label_rule="any")
        name = "(seq)"
    fit, name = (fit_sequence_gbt, f"SeqGBT{name}") if boosted else (fit_sequence_mlp, f"SeqMLP{name}")
    scored = fit(data, with_id=improved).select(F.lit(name).alias("model"), "frame_id", "label", "score")
    return M.round_doubles(M.metrics_table(M.eval_with_thresholds(land(scored, "window-scores"), thr=0.5)))


@register("seq_mlp_metrics")
def q_seq_mlp_metrics(spark, sf_dir):
    """Flattened T=10 windows (label = any attack frame), split by ID, MLP."""
    return _seq_metrics(spark, sf_dir, improved=False)


@register("seq_id_mlp_metrics")
def q_seq_id_mlp_metrics(spark, sf_dir):
    """T=20 windows of 32 context features (label = attack share >= 0.3) + encoded ID, MLP."""
    return _seq_metrics(spark, sf_dir, improved=True)


@register("seq_gbt_metrics")
def q_seq_gbt_metrics(spark, sf_dir):
    """Flattened T=10 windows (label = any attack frame), split by ID, gradient-boosted trees."""
    return _seq_metrics(spark, sf_dir, improved=False, boosted=True)


@register("seq_id_gbt_metrics")
def q_seq_id_gbt_metrics(spark, sf_dir):
    """T=20 windows of 32 context features + encoded ID, gradient-boosted trees."""
    return _seq_metrics(spark, sf_dir, improved=True, boosted=True)


_ID_RATE = """SELECT p.frame_id, p.split,
  round(CASE WHEN p.split = 'train' THEN (a.p - f.p + 20 * o.share) / (a.n - f.n + 20)
             WHEN a.n IS NULL THEN o.share ELSE (a.p + 20 * o.share) / (a.n + 20) END, 9) AS id_rate
FROM folded p LEFT JOIN (SELECT ID, count(*) AS n, CAST(sum(label) AS BIGINT) AS p FROM folded WHERE split = 'train' GROUP BY ID) a ON a.ID = p.ID
LEFT JOIN (SELECT ID, fold, count(*) AS n, CAST(sum(label) AS BIGINT) AS p FROM folded WHERE split = 'train' GROUP BY ID, fold) f
  ON f.ID = p.ID AND f.fold = p.fold
CROSS JOIN (SELECT avg(CAST(label AS DOUBLE)) AS share FROM folded WHERE split = 'train') o"""
_FOLDED = "SELECT *, CAST('0x' || substr(sha1('42:' || frame_id), 1, 8) AS BIGINT) % 5 AS fold FROM prepared"


@register("id_target_encoding", oracle(_ID_RATE, ["prepared"], [("folded", _FOLDED)]))
def q_id_target_encoding(spark, sf_dir):
    """Out-of-fold smoothed attack rate of each frame's ID (the input that stands for the ID)."""
    from canframes.operators.target_encoding import target_encode

    return M.round_doubles(target_encode(prepared(spark, sf_dir), "ID").select("frame_id", "split", "id_rate"))


@register("logreg_irls_metrics")
def q_logreg_irls_metrics(spark, sf_dir):
    """Balanced L2 logistic regression with the bias penalized (Newton / IRLS, one
    aggregate per iteration); metrics row on the test split."""
    from canframes.operators.irls import fit_irls, predict_proba

    z, _ = standardized(spark, sf_dir)
    beta = fit_irls(z.filter(F.col("split") == "train"))
    scored = predict_proba(z.filter(F.col("split") == "test"), beta).select(F.lit("LogReg(balanced, IRLS)").alias("model"), "frame_id", "label", "score")
    return M.round_doubles(M.metrics_table(M.eval_with_thresholds(scored, thr=None)))



@register("train_evaluate")
def q_train_evaluate(spark, sf_dir):
    """All detectors on one split: metrics table (one row per model) with the leakage
    audit numbers attached to every row."""
    from canframes.plans.train_evaluate import train_evaluate

    metrics, audit = train_evaluate(spark, sf_dir)
    a = audit.first()  # three numbers
    return metrics.withColumns({"n_overlap": F.lit(a.n_overlap), "n_dup": F.lit(a.n_dup), "n_test": F.lit(a.n_test)})
