"""Queries: thresholds, confusion, metric reports, curves, AUC / AP, best-F1 tuning."""

from __future__ import annotations

from canframes.operators import metrics as M
from canframes.plans.catalog import register
from canframes.plans.fixtures import oracle, scores


def div(a: str, b: str) -> str:
    """SQL twin of the zero-division rule (0 when the denominator is 0)."""
    return f"COALESCE(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0), CAST(0 AS DOUBLE))"


def rates(tp: str, fp: str, P: str, N: str, suffix: str = "") -> str:
    fn, tn = f"({P} - {tp})", f"({N} - {fp})"
    return ", ".join(
        [
            f"round({div(f'{tp} + {tn}', f'{P} + {N}')}, 9) AS acc{suffix}",
            f"round({div(tp, f'{tp} + {fp}')}, 9) AS prec{suffix}",
            f"round({div(tp, P)}, 9) AS rec{suffix}",
            f"round({div(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')}, 9) AS f1{suffix}",
        ]
    )


RULE_SQL = """SELECT model, min(score) AS min_score, max(score) AS max_score,
  CASE WHEN min(score) < 0 OR max(score) > 1 THEN CAST(0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS thr_default
  FROM scores GROUP BY model"""

CUM_SQL = """SELECT model, score, p, n,
  sum(p) OVER w AS tp, sum(n) OVER w AS fp, row_number() OVER w AS idx,
  sum(p) OVER (PARTITION BY model) AS tot_p, sum(n) OVER (PARTITION BY model) AS tot_n,
  count(*) OVER (PARTITION BY model) AS m
FROM (SELECT model, score, CAST(sum(label) AS BIGINT) AS p, CAST(sum(1 - label) AS BIGINT) AS n
      FROM scores GROUP BY model, score) g
WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

AUC_SQL = """SELECT model, CASE WHEN max(tot_p) > 0 AND max(tot_n) > 0
  THEN sum(n * (tp - p / 2.0)) / (CAST(max(tot_p) AS DOUBLE) * max(tot_n)) ELSE CAST('nan' AS DOUBLE) END AS auc
  FROM cum GROUP BY model"""


def best_sql(eps: str) -> str:
    return f"""SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold ASC) AS r FROM (
    SELECT model, score AS threshold, tp, fp, tot_p, tot_n, pr, rc,
           CAST(2 AS DOUBLE) * pr * rc / (pr + rc + {eps}) AS f1
    FROM (SELECT *, {div('tp', 'tp + fp')} AS pr,
                 CASE WHEN tot_p > 0 THEN CAST(tp AS DOUBLE) / tot_p ELSE CAST(1 AS DOUBLE) END AS rc FROM cum) a) b) c
  WHERE r = 1"""


def at_sql(thr_table: str) -> str:
    """Counts at a per-model threshold from the curve (max cumulative count with score >= thr)."""
    return f"""SELECT c.model, t.thr, COALESCE(max(CASE WHEN c.score >= t.thr THEN c.tp END), 0) AS tp,
  COALESCE(max(CASE WHEN c.score >= t.thr THEN c.fp END), 0) AS fp, max(c.tot_p) AS tot_p, max(c.tot_n) AS tot_n
  FROM cum c JOIN {thr_table} t USING (model) GROUP BY c.model, t.thr"""


def _scores(spark, sf_dir):
    return scores(spark, sf_dir)


@register("default_threshold", oracle(f"SELECT * FROM ({RULE_SQL}) r", ["scores"]))
def q_default_threshold(spark, sf_dir):
    return M.threshold_rule(_scores(spark, sf_dir))


@register(
    "confusion",
    oracle(
        """SELECT s.model, count(*) FILTER (WHERE s.score < r.thr_default AND s.label = 0) AS tn,
                  count(*) FILTER (WHERE s.score >= r.thr_default AND s.label = 0) AS fp,
                  count(*) FILTER (WHERE s.score < r.thr_default AND s.label = 1) AS fn,
                  count(*) FILTER (WHERE s.score >= r.thr_default AND s.label = 1) AS tp
           FROM scores s JOIN rule r USING (model) GROUP BY s.model""",
        ["scores"],
        [("rule", RULE_SQL)],
    ),
)
def q_confusion(spark, sf_dir):
    return M.confusion(_scores(spark, sf_dir))


@register(
    "metrics_report",
    oracle(
        f"""SELECT a.model, a.thr, {rates('a.tp', 'a.fp', 'a.tot_p', 'a.tot_n')}, round(u.auc, 9) AS auc
            FROM atc a JOIN auc u USING (model)""",
        ["scores"],
        [("rule", RULE_SQL), ("thr", "SELECT model, thr_default AS thr FROM rule"), ("cum", CUM_SQL), ("atc", at_sql("thr")), ("auc", AUC_SQL)],
    ),
)
def q_metrics_report(spark, sf_dir):
    return M.round_doubles(M.metrics_report(_scores(spark, sf_dir)))


@register("roc_auc", oracle("SELECT model, round(auc, 9) AS auc FROM auc", ["scores"], [("cum", CUM_SQL), ("auc", AUC_SQL)]))
def q_roc_auc(spark, sf_dir):
    return M.round_doubles(M.auc_and_totals(M.curve(_scores(spark, sf_dir))).select("model", "auc"))


_ROC = """SELECT model, round(threshold, 9) AS threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM (
  SELECT model, score AS threshold,
         CASE WHEN tot_n > 0 THEN CAST(fp AS DOUBLE) / tot_n ELSE CAST('nan' AS DOUBLE) END AS fpr,
         CASE WHEN tot_p > 0 THEN CAST(tp AS DOUBLE) / tot_p ELSE CAST('nan' AS DOUBLE) END AS tpr
  FROM (SELECT *, lag(tp) OVER o AS tp0, lead(tp) OVER o AS tp2, lag(fp) OVER o AS fp0, lead(fp) OVER o AS fp2
        FROM cum WINDOW o AS (PARTITION BY model ORDER BY idx)) x
  WHERE NOT (m > 2 AND tp0 IS NOT NULL AND tp2 IS NOT NULL AND fp2 - 2 * fp + fp0 = 0 AND tp2 - 2 * tp + tp0 = 0)
  UNION ALL
  SELECT DISTINCT model, CAST('inf' AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM cum) r"""


@register("roc_curve", oracle(_ROC, ["scores"], [("cum", CUM_SQL)]))
def q_roc_curve(spark, sf_dir):
    return M.round_doubles(M.roc_curve(M.shared_curve(_scores(spark, sf_dir))))


_PR = f"""SELECT model, round(threshold, 9) AS threshold, round(precision, 9) AS precision, round(recall, 9) AS recall FROM (
  SELECT model, score AS threshold, {div('tp', 'tp + fp')} AS precision,
         CASE WHEN tot_p > 0 THEN CAST(tp AS DOUBLE) / tot_p ELSE CAST(1 AS DOUBLE) END AS recall FROM cum
  UNION ALL
  SELECT DISTINCT model, CAST(NULL AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM cum) r"""


@register("pr_curve", oracle(_PR, ["scores"], [("cum", CUM_SQL)]))
def q_pr_curve(spark, sf_dir):
    return M.round_doubles(M.pr_curve(M.shared_curve(_scores(spark, sf_dir))))


@register(
    "average_precision",
    oracle(
        f"SELECT model, round(COALESCE(sum(CAST(p AS DOUBLE) / NULLIF(tot_p, 0) * {div('tp', 'tp + fp')}), 0), 9) AS ap FROM cum GROUP BY model",
        ["scores"],
        [("cum", CUM_SQL)],
    ),
)
def q_average_precision(spark, sf_dir):
    return M.round_doubles(M.average_precision(M.curve(_scores(spark, sf_dir))))


@register(
    "best_f1",
    oracle(
        "SELECT model, round(threshold, 9) AS threshold, round(pr, 9) AS precision, round(rc, 9) AS recall, round(f1, 9) AS f1 FROM best",
        ["scores"],
        [("cum", CUM_SQL), ("best", best_sql("1e-9"))],
    ),
)
def q_best_f1(spark, sf_dir):
    return M.round_doubles(M.best_threshold_by_f1(M.curve(_scores(spark, sf_dir))))


@register(
    "tune_and_report",
    oracle(
        f"""SELECT b.model, round(b.threshold, 9) AS thr, {rates('b.tp', 'b.fp', 'b.tot_p', 'b.tot_n')}, round(u.auc, 9) AS auc
            FROM best b JOIN auc u USING (model)""",
        ["scores"],
        [("cum", CUM_SQL), ("best", best_sql("1e-9")), ("auc", AUC_SQL)],
    ),
)
def q_tune_and_report(spark, sf_dir):
    return M.round_doubles(M.tune_and_report(_scores(spark, sf_dir)))


_EVAL_CTES = [
    ("cum", CUM_SQL),
    ("thr", "SELECT DISTINCT model, CAST(0.5 AS DOUBLE) AS thr FROM cum"),
    ("atc", at_sql("thr")),
    ("auc", AUC_SQL),
    ("best", best_sql("1e-12")),
]


@register(
    "eval_with_thresholds",
    oracle(
        f"""SELECT a.model, a.thr AS thr_default, {rates('a.tp', 'a.fp', 'a.tot_p', 'a.tot_n')}, round(u.auc, 9) AS auc,
                   round(b.threshold, 9) AS thr_bestF1, {rates('b.tp', 'b.fp', 'b.tot_p', 'b.tot_n', '_b')}, round(b.f1, 9) AS bestF1
            FROM atc a JOIN auc u USING (model) JOIN best b USING (model)""",
        ["scores"],
        _EVAL_CTES,
    ),
)
def q_eval_with_thresholds(spark, sf_dir):
    return M.round_doubles(M.eval_with_thresholds(_scores(spark, sf_dir), thr=0.5))


@register(
    "model_comparison",
    oracle(
        f"""SELECT a.model, a.thr AS thr_default, {rates('a.tp', 'a.fp', 'a.tot_p', 'a.tot_n')}, round(u.auc, 9) AS auc,
                   round(b.threshold, 9) AS thr_bestF1, {rates('b.tp', 'b.fp', 'b.tot_p', 'b.tot_n', '_bestF1')}
            FROM atc a JOIN auc u USING (model) JOIN best b USING (model)""",
        ["scores"],
        _EVAL_CTES,
    ),
)
def q_model_comparison(spark, sf_dir):
    """The 12-column metrics table, one row per model."""
    return M.round_doubles(M.metrics_table(M.eval_with_thresholds(_scores(spark, sf_dir), thr=0.5)))

