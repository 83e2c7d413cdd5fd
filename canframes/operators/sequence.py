"""Per-ID sequence operators: ID index, context features (first difference, rolling mean and
sample std of 5), sliding count-windows with label rules, window contents, and the
window-weighted scaler fit.

All run on positions from ``with_positions`` and on (ID, block) partitions from
``blocked`` so that a dominant ID is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canframes.functions.clean import fill_zero, parse_number
from canframes.functions.hashing import shuffle_key
from canframes.operators.positions import DEFAULT_BLOCK_ROWS, block_window, blocked, owned, with_positions
from canframes.schema import FEATURES, N_COL, POS_COL, ROLL_WINDOW, resolve_time_column
from canframes.session import land

ROLL = ROLL_WINDOW


def order_columns(
    df: DataFrame, frame_key: str = "frame_id", seed: int = 42, fallback: list[str] | None = None, time_columns: list[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """Sort keys inside an ID (nulls last): the time column when present, then the row order
    as tie-break (stable sort). Without a time column: ``fallback`` (e.g. the concatenation
    order source_rank, frame_seq) or, by default, the seeded shuffle order of the frames."""
    ts = resolve_time_column(df.columns, time_columns)
    tail = fallback or [frame_key]
    if ts is not None:
        if df.schema[ts].dataType.typeName() == "string":
            # times read as text: numbers by value first, then other text (dates) as written
            return df.withColumn("_time", parse_number(F.col(ts), "double")), ["_time", ts, *tail]
        return df, [ts, *tail]
    if fallback:
        return df, list(fallback)
    return df.withColumn("_shuffle", shuffle_key(frame_key, seed)), ["_shuffle", frame_key]


def positions(
    df: DataFrame, key: str = "ID", frame_key: str = "frame_id", fallback: list[str] | None = None, time_columns: list[str] | None = None, **kw
) -> DataFrame:
    df2, order = order_columns(df, frame_key, fallback=fallback, time_columns=time_columns)
    out = with_positions(df2, key, order, **kw)
    return out.drop("_shuffle", "_time")


def id_index(df: DataFrame, key: str = "ID", out: str = "id_idx") -> DataFrame:
    """Dense 0-based index of each ID in sorted ID order; null IDs have none.

    IDs compare as their own type; IDs read as text compare as numbers if every one of them
    is a plain number (as a reader that infers types would see them), else as text."""
    ids = df.select(key).filter(F.col(key).isNotNull()).distinct()
    order = [key]
    if ids.schema[key].dataType.typeName() == "string":
        ids = land(ids, "ids")
        if not ids.agg(F.count_if(parse_number(F.col(key), "double").isNull())).first()[0]:
            ids, order = ids.withColumn("_num", parse_number(F.col(key), "double")), ["_num", key]
    ranked = with_positions(ids.withColumn("_all", F.lit(0)), "_all", order, pos="_p", n="_n")
    return ranked.select(key, F.col("_p").alias(out))


def context_features(base: list[str] | None = None) -> list[str]:
    base = base or FEATURES
    return base + [f"{c}_diff1" for c in base] + [f"{c}_roll5_mean" for c in base] + [f"{c}_roll5_std" for c in base]


def add_sequence_context(
    df_pos: DataFrame, base: list[str] | None = None, key: str = "ID", block_rows: int = DEFAULT_BLOCK_ROWS, fill: bool = True
) -> DataFrame:
    """First difference, rolling mean and rolling sample std over 5 frames per ID.

    A rolling value needs 5 non-null values in its frame, else null; nulls then become 0
    (every column of the table is filled)."""
    base = base or FEATURES
    b = blocked(df_pos, lookback=ROLL - 1, block_rows=block_rows)
    w = block_window(key)
    r5 = w.rowsBetween(-(ROLL - 1), 0)
    known = F.col(key).isNotNull()  # rows without an ID belong to no sequence
    cols = []
    for c in base:
        x = F.col(c).cast("double")
        full = known & (F.count(x).over(r5) == ROLL)
        cols += [
            F.when(known, x - F.lag(x, 1).over(w)).alias(f"{c}_diff1"),
            F.when(full, F.avg(x).over(r5)).alias(f"{c}_roll5_mean"),
            F.when(full, F.stddev_samp(x).over(r5)).alias(f"{c}_roll5_std"),
        ]
    out = owned(b.select("*", *cols))
    return fill_zero(out) if fill else out


def _window_label(rule: str, timesteps: int, pos_ratio: float, w_fwd: Window, w: Window) -> Column:
    lab = F.col("label").cast("int")
    if rule == "last":
        return F.lead(lab, timesteps - 1).over(w)
    if rule in ("any", "max"):
        return F.max(lab).over(w_fwd)
    # any other rule string: share of positive frames >= pos_ratio
    return (F.sum(lab).over(w_fwd).cast("double") / F.lit(float(timesteps)) >= F.lit(float(pos_ratio))).cast("int")


def sequence_windows(
    df_pos: DataFrame,
    timesteps: int = 10,
    step: int = 1,
    label_rule: str = "any",
    pos_ratio: float = 0.3,
    key: str = "ID",
    block_rows: int = DEFAULT_BLOCK_ROWS,
    carry: list[str] | None = None,
    frames_of: list[str] | None = None,
) -> DataFrame:
    """One row per full window (start 0, every ``step`` rows, only complete windows):
    ``key``, ``start`` (position of the first frame), ``start_frame_id``, ``y``; with
    ``frames_of`` also ``frames`` = the window's T x F values flattened (same pass)."""
    carry = carry or []
    b = blocked(df_pos, lookahead=timesteps - 1, block_rows=block_rows)
    w = block_window(key)
    fwd = w.rowsBetween(0, timesteps - 1)
    extra = [_window_label(label_rule, timesteps, pos_ratio, fwd, w).cast("int").alias("y")]
    if frames_of:
        vec = F.array(*[F.col(c).cast("double") for c in frames_of])
        extra.append(F.flatten(F.collect_list(vec).over(fwd)).alias("frames"))
    starts = (F.col(POS_COL) % step == 0) & (F.col(POS_COL) + timesteps <= F.col(N_COL))
    out = owned(b.select("*", *extra)).filter(starts)
    return out.select(
        key, F.col(POS_COL).alias("start"), F.col("frame_id").alias("start_frame_id"), "y", *(["frames"] if frames_of else []), *carry
    )


def window_blocks(
    df_pos: DataFrame, timesteps: int, step: int = 1, label_rule: str = "any", pos_ratio: float = 0.3, key: str = "ID", block_rows: int = DEFAULT_BLOCK_ROWS
) -> DataFrame:
    """The frames of each block with the look-ahead frames that its last windows need (``_own``
    False), and ``y`` of the window that starts at a frame where ``is_start``."""
    b = blocked(df_pos, lookahead=timesteps - 1, block_rows=block_rows)
    w = block_window(key)
    y = _window_label(label_rule, timesteps, pos_ratio, w.rowsBetween(0, timesteps - 1), w).cast("int")
    starts = F.col("_own") & (F.col(POS_COL) % step == 0) & (F.col(POS_COL) + timesteps <= F.col(N_COL))
    return b.select("*", y.alias("y"), starts.alias("is_start"))


def _starts_covering(timesteps: int, step: int) -> tuple[Column, Column]:
    """First and last valid window start (multiples of ``step``) whose window holds the
    frame at ``pos`` in an ID of ``n`` frames."""
    p, n = F.col(POS_COL), F.col(N_COL)
    lo = F.greatest(p - (timesteps - 1), F.lit(0))
    hi = F.least(p, n - timesteps)
    lo_k = F.ceil(lo / step)
    hi_k = F.floor(hi / step)
    return lo_k, hi_k


def window_weight(timesteps: int, step: int = 1) -> Column:
    """How many windows hold the frame at ``pos`` (0 when the ID is shorter than T)."""
    lo_k, hi_k = _starts_covering(timesteps, step)
    return F.when(F.col(N_COL) >= timesteps, F.greatest(hi_k - lo_k + 1, F.lit(0))).otherwise(F.lit(0)).cast("long")


def window_contents(df_pos: DataFrame, timesteps: int = 10, step: int = 1, features: list[str] | None = None, key: str = "ID") -> DataFrame:
    """Un-nested window tensor: one row per (window, offset) with the frame's payload.

    A narrow explode of each frame into the windows holding it (no shuffle, no window
    function); T copies of each frame, as the tensor itself holds."""
    features = features or FEATURES
    lo_k, hi_k = _starts_covering(timesteps, step)
    ks = F.when((F.col(N_COL) >= timesteps) & (hi_k >= lo_k), F.sequence(lo_k, hi_k)).otherwise(F.array().cast("array<bigint>"))
    e = df_pos.withColumn("_k", F.explode(ks))
    start = (F.col("_k") * step).cast("long")
    return e.select(key, start.alias("start"), (F.col(POS_COL) - start).cast("int").alias("offset"), "frame_id", *features)


def window_tensor(df_pos: DataFrame, timesteps: int, step: int = 1, features: list[str] | None = None, key: str = "ID", block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Nested form for the ML edge: ``frames`` = flattened T x F float vector per window."""
    w = sequence_windows(df_pos, timesteps, step, key=key, block_rows=block_rows, frames_of=features or FEATURES)
    return w.select(key, "start", "frames")


def weighted_scaler(df_pos: DataFrame, timesteps: int, step: int = 1, features: list[str] | None = None) -> DataFrame:
    """Mean and population std of each feature over the flattened windows, computed on the
    frames with their window counts as weights (no T-fold copy). Long form:
    (feature, mean, scale) with scale 1 for a constant feature."""
    features = features or FEATURES
    w = window_weight(timesteps, step)
    x = lambda c: F.col(c).cast("double")
    first = df_pos.agg(F.sum(w).alias("_w"), *[(F.sum(w * x(c)) / F.sum(w)).alias(c) for c in features]).first()
    mean = {c: first[c] if first[c] is not None else 0.0 for c in features}
    # squares around the mean: no cancellation, however large the values or the table
    dev = df_pos.agg(F.sum(w).alias("_w"), *[F.sum(w * F.pow(x(c) - F.lit(mean[c]), 2)).alias(f"_q_{c}") for c in features])
    stack = ", ".join(f"'{c}', CAST({mean[c]!r} AS DOUBLE), _q_{c}" for c in features)
    long = dev.select("_w", F.expr(f"stack({len(features)}, {stack}) AS (feature, mean, q)"))
    var = F.col("q") / F.col("_w")
    return long.select("feature", "mean", F.when(var > 0, F.sqrt(var)).otherwise(F.lit(1.0)).alias("scale"))


def n_windows(n: int, timesteps: int, step: int) -> int:
    """Windows of an ID with n frames (driver-side helper for tests)."""
    return 0 if n < timesteps else 1 + (n - timesteps) // step

