"""Queries: positions inside an ID, context features, ID index, sliding windows, window
contents, window split by ID and the window-weighted scaler."""

from __future__ import annotations

from pyspark.sql import functions as F

from canframes.operators import sequence as Q
from canframes.operators.metrics import round_doubles
from canframes.operators.split import split_column
from canframes.plans.catalog import register
from canframes.plans.fixtures import CLEAN_SQL, LINE_FRAMES_SQL, clean_view, oracle
from canframes.schema import (
    BASIC_RULE,
    BASIC_STEP,
    BASIC_TIMESTEPS,
    FEATURES,
    IMPROVED_POS_RATIO,
    IMPROVED_RULE,
    IMPROVED_STEP,
    IMPROVED_TIMESTEPS,
)

POS_SQL = """SELECT *, row_number() OVER (PARTITION BY ID ORDER BY ts, frame_id) - 1 AS pos,
  count(*) OVER (PARTITION BY ID) AS n_in_id FROM clean"""


def framed(spark, sf_dir):
    """Cleaned frames with their position inside the ID (time order, frame id tie-break)."""
    return Q.positions(clean_view(spark, sf_dir))


@register("group_positions", oracle("SELECT frame_id, ID, pos, n_in_id FROM fpos", ["clean"], [("fpos", POS_SQL)]))
def q_group_positions(spark, sf_dir):
    return framed(spark, sf_dir).select("frame_id", "ID", "pos", "n_in_id")


def _context_sql() -> str:
    cols = []
    for c in FEATURES:
        x = f"CAST({c} AS DOUBLE)"
        cols.append(f"COALESCE(round({x} - lag({x}) OVER w, 6), 0) AS {c}_diff1")
    for c in FEATURES:
        x = f"CAST({c} AS DOUBLE)"
        cols.append(f"COALESCE(CASE WHEN count({x}) OVER r = 5 THEN round(avg({x}) OVER r, 6) END, 0) AS {c}_roll5_mean")
    for c in FEATURES:
        x = f"CAST({c} AS DOUBLE)"
        cols.append(f"COALESCE(CASE WHEN count({x}) OVER r = 5 THEN round(stddev_samp({x}) OVER r, 6) END, 0) AS {c}_roll5_std")
    return (
        "SELECT frame_id, ID, pos, label, " + ", ".join(FEATURES) + ", " + ", ".join(cols)
        + " FROM fpos WINDOW w AS (PARTITION BY ID ORDER BY pos), r AS (PARTITION BY ID ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    )


@register("seq_context", oracle(_context_sql(), ["clean"], [("fpos", POS_SQL)]))
def q_seq_context(spark, sf_dir):
    ctx = Q.add_sequence_context(framed(spark, sf_dir))
    return round_doubles(ctx.select("frame_id", "ID", "pos", "label", *Q.context_features()), 6)


@register(
    "id_index",
    oracle("SELECT ID, CAST(row_number() OVER (ORDER BY ID) - 1 AS INT) AS id_idx FROM (SELECT DISTINCT ID FROM clean) d", ["clean"]),
)
def q_id_index(spark, sf_dir):
    return Q.id_index(clean_view(spark, sf_dir))


def windows_sql(T: int, step: int, rule: str, ratio: float = 0.3) -> str:
    f = f"(PARTITION BY ID ORDER BY pos ROWS BETWEEN CURRENT ROW AND {T - 1} FOLLOWING)"
    if rule == "last":
        y = f"lead(label, {T - 1}) OVER (PARTITION BY ID ORDER BY pos)"
    elif rule == "any":
        y = f"max(label) OVER {f}"
    else:
        y = f"CASE WHEN CAST(sum(label) OVER {f} AS DOUBLE) / CAST({T} AS DOUBLE) >= CAST({ratio} AS DOUBLE) THEN 1 ELSE 0 END"
    return f"""SELECT ID, pos AS start, frame_id AS start_frame_id, CAST(y AS INT) AS y FROM (
      SELECT ID, pos, n_in_id, frame_id, {y} AS y FROM fpos) x WHERE pos % {step} = 0 AND pos + {T} <= n_in_id"""


def _register_windows(name: str, T: int, step: int, rule: str, ratio: float = 0.3):
    @register(name, oracle(windows_sql(T, step, rule, ratio), ["clean"], [("fpos", POS_SQL)]))
    def q(spark, sf_dir):
        return Q.sequence_windows(framed(spark, sf_dir), timesteps=T, step=step, label_rule=rule, pos_ratio=ratio)

    q.__name__ = f"q_{name}"
    return q


q_windows_any = _register_windows("windows_any", BASIC_TIMESTEPS, BASIC_STEP, BASIC_RULE)
q_windows_last = _register_windows("windows_last", IMPROVED_TIMESTEPS, IMPROVED_STEP, "last")
q_windows_ratio = _register_windows("windows_ratio", IMPROVED_TIMESTEPS, IMPROVED_STEP, IMPROVED_RULE, IMPROVED_POS_RATIO)
q_windows_step3 = _register_windows("windows_step3", 10, 3, "any")


@register(
    "window_contents",
    oracle(
        "SELECT w.ID, w.start, CAST(f.pos - w.start AS INT) AS offset, f.frame_id, "
        + ", ".join(f"f.{c}" for c in FEATURES)
        + " FROM win w JOIN fpos f ON f.ID = w.ID AND f.pos BETWEEN w.start AND w.start + 9",
        ["clean"],
        [("fpos", POS_SQL), ("win", windows_sql(10, 1, "any"))],
    ),
)
def q_window_contents(spark, sf_dir):
    return Q.window_contents(framed(spark, sf_dir), timesteps=10, step=1)


_WSPLIT_CTE = [
    ("fpos", POS_SQL),
    ("win", windows_sql(10, 1, "any")),
    (
        "idsplit",
        """SELECT ID, CASE WHEN rn <= k THEN 'test' ELSE 'train' END AS split FROM (
             SELECT ID, row_number() OVER (ORDER BY sha1('42:' || CAST(ID AS VARCHAR))) AS rn,
                    CEIL(0.2 * count(*) OVER ()) AS k FROM (SELECT DISTINCT ID FROM win) d) r""",
    ),
]


def window_split(spark, sf_dir, timesteps: int = 10):
    """Frames with positions, their windows, and the split rule by ID. The groups are the
    IDs that have a window (at least T frames): one small count per ID, so fitting the
    split never computes the windows."""
    fp = framed(spark, sf_dir)
    win = Q.sequence_windows(fp, timesteps=timesteps)
    ids = clean_view(spark, sf_dir).groupBy("ID").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= timesteps)
    return fp, win, split_column(ids, "ID")


@register(
    "window_split",
    oracle("SELECT w.ID, s.split, count(*) AS n_windows FROM win w JOIN idsplit s USING (ID) GROUP BY w.ID, s.split", ["clean"], _WSPLIT_CTE),
)
def q_window_split(spark, sf_dir):
    _, win, rule = window_split(spark, sf_dir)
    return win.withColumn("split", rule).groupBy("ID", "split").agg(F.count(F.lit(1)).alias("n_windows"))


def _weighted_sql() -> str:
    w = "CASE WHEN n_in_id >= 10 THEN GREATEST(FLOOR(LEAST(pos, n_in_id - 10)) - CEIL(GREATEST(pos - 9, 0)) + 1, 0) ELSE 0 END"
    sums = ", ".join(
        f"sum(wt * CAST({c} AS DOUBLE)) AS s_{c}, sum(wt * CAST({c} AS DOUBLE) * CAST({c} AS DOUBLE)) AS q_{c}" for c in FEATURES
    )
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, s_{c} AS s, q_{c} AS q, w FROM agg" for c in FEATURES
    )
    return (
        f"WITH tr AS (SELECT f.*, CAST({w} AS DOUBLE) AS wt FROM fpos f JOIN idsplit s USING (ID) WHERE s.split = 'train'), "
        f"agg AS (SELECT sum(wt) AS w, {sums} FROM tr), long AS ({parts}) "
        "SELECT feature, round(s / w, 6) AS mean, "
        "round(CASE WHEN GREATEST((w * q - s * s) / (w * w), 0) > 0 THEN sqrt(GREATEST((w * q - s * s) / (w * w), 0)) ELSE 1 END, 6) AS scale FROM long"
    )


@register("window_scaler", oracle("SELECT * FROM (" + _weighted_sql() + ") z", ["clean"], _WSPLIT_CTE))
def q_window_scaler(spark, sf_dir):
    fp, _, rule = window_split(spark, sf_dir)
    train = fp.withColumn("split", rule).filter(F.col("split") == "train")
    return round_doubles(Q.weighted_scaler(train, timesteps=10), 6)


@register(
    "line_windows",
    "WITH frames AS (" + LINE_FRAMES_SQL + "), clean AS (" + CLEAN_SQL + "), fpos AS (" + POS_SQL + ")\n"
    + "SELECT y, count(*) AS n_windows, CAST(sum(start) AS BIGINT) AS sum_start FROM (" + windows_sql(20, 1, "ratio", 0.3) + ") w GROUP BY y",
)
def q_line_windows(spark, sf_dir):
    """T=20 ratio windows per ID on the lineitem stand-in frames (30k frames per ID at
    sf0.1), summarized per window label."""
    from canframes.functions.clean import drop_incomplete, read_and_clean
    from canframes.plans.fixtures import line_frames

    fp = Q.positions(drop_incomplete(read_and_clean(line_frames(spark, sf_dir))))
    w = Q.sequence_windows(fp, timesteps=20, label_rule="ratio", pos_ratio=0.3)
    return w.groupBy("y").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("start").cast("bigint").alias("sum_start"))
