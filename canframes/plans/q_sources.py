"""Queries: CSV sources and sinks end to end (write the fixture files into the shared work
folder, read them back through the source operators)."""

from __future__ import annotations

from pyspark.sql import functions as F

from canframes.operators import metrics as M
from canframes.plans.catalog import register
from canframes.plans.q_metrics import AUC_SQL, CUM_SQL
from canframes.plans.fixtures import SOURCE_RANK_SQL, SRC_SQL, frames_raw_with_source, number_sql, oracle, scores
from canframes.schema import BENIGN_FILE, FEATURES
from canframes.session import work_path
from canframes.sources.frame_csv import (
    combined_order,
    load_frames,
    scan_class,
    scan_csv,
    source_paths,
    with_file_positions,
    write_ordered_csv,
    write_source_files,
)
from canframes.sources.score_csv import compare_files

_RS = [("src", SRC_SQL), ("rs", "SELECT r.* REPLACE (nullif(ID, 'NA') AS ID, CASE WHEN DATA_1 NOT IN ('NA', 'NaN', 'null') THEN trim(DATA_1) END AS DATA_1), s.source FROM frames_raw r JOIN src s USING (frame_id)")]
_CLEAN_COLS = ", ".join(f"{number_sql(c)} AS {c}" for c in FEATURES)
_NOID_WHERE = " AND ".join(f"{number_sql(c)} IS NOT NULL" for c in FEATURES)


def write_fixture(spark, sf_dir, with_id: bool = True) -> str:
    out = work_path(spark, "frames-csv")
    drop = ["frame_id"] + ([] if with_id else ["ID"])
    write_source_files(frames_raw_with_source(spark, sf_dir), out, drop=drop)
    return out


@register(
    "csv_round_trip",
    oracle(
        f"""SELECT source, frame_seq, ID, {_CLEAN_COLS}, CASE WHEN source = '{BENIGN_FILE}' THEN 0 ELSE 1 END AS label FROM (
              SELECT *, row_number() OVER (PARTITION BY source ORDER BY frame_id) - 1 AS frame_seq FROM rs) x
            WHERE ID IS NOT NULL AND {_NOID_WHERE}""",
        ["frames_raw"],
        _RS,
    ),
)
def q_csv_round_trip(spark, sf_dir):
    data_dir = write_fixture(spark, sf_dir)
    loaded = load_frames(spark, data_dir, partitioned=True)
    return loaded.frames.select("source", "frame_seq", "ID", *FEATURES, "label")


@register(
    "csv_round_trip_noid",
    oracle(
        f"""SELECT source, frame_seq, 'gid_' || CAST(CAST(floor(class_pos / 50) AS BIGINT) AS VARCHAR) AS ID, {_CLEAN_COLS},
                   CASE WHEN source = '{BENIGN_FILE}' THEN 0 ELSE 1 END AS label FROM (
              SELECT *, row_number() OVER (PARTITION BY source ORDER BY frame_id) - 1 AS frame_seq,
                     row_number() OVER (PARTITION BY source = '{BENIGN_FILE}' ORDER BY {SOURCE_RANK_SQL}, frame_id) - 1 AS class_pos
              FROM rs) x WHERE {_NOID_WHERE}""",
        ["frames_raw"],
        _RS,
    ),
)
def q_csv_round_trip_noid(spark, sf_dir):
    """Files without an ID column: ids ``gid_<pos // 50>`` restart per class."""
    data_dir = write_fixture(spark, sf_dir, with_id=False)
    loaded = load_frames(spark, data_dir, partitioned=True)
    return loaded.frames.select("source", "frame_seq", "ID", *FEATURES, "label")


_RAW_COLS = ["ID", *FEATURES, "label"]


@register(
    "union_sources",
    oracle(
        "SELECT row_number() OVER (ORDER BY CASE WHEN source = '" + BENIGN_FILE + "' THEN -1 ELSE " + SOURCE_RANK_SQL
        + " END, frame_id) - 1 AS row_seq, " + ", ".join(_RAW_COLS) + " FROM rs",
        ["frames_raw"],
        _RS,
    ),
)
def q_union_sources(spark, sf_dir):
    """All six files combined benign first into one CSV dataset, read back in file order."""
    data_dir = write_fixture(spark, sf_dir)
    raw = scan_class(spark, source_paths(data_dir, partitioned=True))
    combined = combined_order(raw).select("row_seq", *_RAW_COLS)
    out = work_path(spark, "combined-csv")
    write_ordered_csv(combined, out, "row_seq")
    back = with_file_positions(scan_csv(spark, out, "combined", 0))
    return back.select(F.col("frame_seq").alias("row_seq"), *_RAW_COLS)


@register(
    "compare_score_files",
    oracle(
        """SELECT CASE model WHEN 'a' THEN 'tree' ELSE 'mlp' END AS model, round(auc, 9) AS auc FROM auc""",
        ["scores"],
        [
            ("cum", CUM_SQL),
            ("auc", AUC_SQL),
        ],
    ),
)
def q_compare_score_files(spark, sf_dir):
    """Two prediction files (text truth + 'Prob'; numeric truth + 'confidence'), aligned by
    row position, truth from the first file; ROC-AUC per file."""
    s = scores(spark, sf_dir)
    a = s.filter("model = 'a'").select(
        "frame_id", F.when(F.col("label") == 1, "ATTACK").otherwise("BENIGN").alias("Label"), F.col("score").alias("Prob")
    )
    b = s.filter("model = 'b'").select("frame_id", F.col("label").alias("y_true"), F.col("score").alias("confidence"))
    pa, pb = work_path(spark, "pred-tree"), work_path(spark, "pred-mlp")
    write_ordered_csv(a, pa, "frame_id")
    write_ordered_csv(b, pb, "frame_id")
    long = compare_files(spark, ("tree", pa), ("mlp", pb))
    return M.round_doubles(M.auc_and_totals(M.curve(long)).select("model", "auc"))


@register("export_artifacts")
def q_export_artifacts(spark, sf_dir):
    """Fit the three export models, write all artifacts, return the written metrics table."""
    from canframes.plans.export import export_artifacts

    return export_artifacts(spark, sf_dir, work_path(spark, "artifacts"))


@register("score_artifacts")
def q_score_artifacts(spark, sf_dir):
    """Export, then load the stored artifacts and score the test split at the stored
    thresholds; confusion counts per model."""
    from canframes.plans.export import export_artifacts, score_with_artifacts

    out = work_path(spark, "artifacts")
    export_artifacts(spark, sf_dir, out)
    scored = score_with_artifacts(spark, sf_dir, out)
    return scored.groupBy("model", "thr").agg(
        F.count_if((F.col("pred") == 1) & (F.col("label") == 1)).alias("tp"),
        F.count_if((F.col("pred") == 1) & (F.col("label") == 0)).alias("fp"),
        F.count_if((F.col("pred") == 0) & (F.col("label") == 1)).alias("fn"),
        F.count_if((F.col("pred") == 0) & (F.col("label") == 0)).alias("tn"),
    )


# --- sequence operators on the file-loaded frames (no time column) -----------------------------

_FILE_POS = f"""SELECT *, row_number() OVER (PARTITION BY source ORDER BY frame_id) - 1 AS frame_seq,
       {SOURCE_RANK_SQL} AS source_rank FROM rs"""


def _ctx_files_sql() -> str:
    cols = []
    for c in FEATURES:
        x = f"CAST({number_sql(c)} AS DOUBLE)"
        cols.append(f"COALESCE(CASE WHEN ID IS NOT NULL THEN round({x} - lag({x}) OVER w, 6) END, 0) AS {c}_diff1")
    for c in FEATURES:
        x = f"CAST({number_sql(c)} AS DOUBLE)"
        cols.append(f"COALESCE(CASE WHEN ID IS NOT NULL AND count({x}) OVER r = 5 THEN round(avg({x}) OVER r, 6) END, 0) AS {c}_roll5_mean")
    for c in FEATURES:
        x = f"CAST({number_sql(c)} AS DOUBLE)"
        cols.append(f"COALESCE(CASE WHEN ID IS NOT NULL AND count({x}) OVER r = 5 THEN round(stddev_samp({x}) OVER r, 6) END, 0) AS {c}_roll5_std")
    base = ", ".join(f"COALESCE({number_sql(c)}, 0) AS {c}" for c in FEATURES)
    return (
        f"SELECT source, frame_seq, COALESCE(ID, '0.0') AS ID, CASE WHEN source = '{BENIGN_FILE}' THEN 0 ELSE 1 END AS label, {base}, " + ", ".join(cols)
        + " FROM fp WINDOW w AS (PARTITION BY ID ORDER BY source_rank, frame_seq),"
        " r AS (PARTITION BY ID ORDER BY source_rank, frame_seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    )


@register("seq_context_files", oracle(_ctx_files_sql(), ["frames_raw"], _RS + [("fp", _FILE_POS)]))
def q_seq_context_files(spark, sf_dir):
    """Context features on the uncleaned class tables (rows with bad payloads kept),
    ordered inside an ID by the concatenation order (attack files, then benign), then
    every null filled with 0."""
    from canframes.operators import sequence as Q
    from canframes.operators.metrics import round_doubles

    loaded = load_frames(spark, write_fixture(spark, sf_dir), partitioned=True)
    both = loaded.attack_df.unionByName(loaded.benign_df)
    fp = Q.positions(both, fallback=["source_rank", "frame_seq"])
    ctx = Q.add_sequence_context(fp)
    return round_doubles(ctx.select("source", "frame_seq", "ID", "label", *Q.context_features()), 6)


_SHUF = f"""SELECT *, row_number() OVER (PARTITION BY ID ORDER BY sha1('42:' || CAST(frame_key AS VARCHAR)), frame_key) - 1 AS pos,
       count(*) OVER (PARTITION BY ID) AS n_in_id FROM (
  SELECT ID, frame_id AS fid, CAST(source_rank AS BIGINT) * 1099511627776 + frame_seq AS frame_key,
         CASE WHEN source = '{BENIGN_FILE}' THEN 0 ELSE 1 END AS label FROM fp
  WHERE ID IS NOT NULL AND {_NOID_WHERE}) c"""


@register(
    "windows_files",
    oracle(
        """SELECT ID, pos AS start, frame_key AS start_frame_id, CAST(y AS INT) AS y FROM (
             SELECT ID, pos, n_in_id, frame_key, max(label) OVER (PARTITION BY ID ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS y
             FROM sp) x WHERE pos + 10 <= n_in_id""",
        ["frames_raw"],
        _RS + [("fp", _FILE_POS), ("sp", _SHUF)],
    ),
)
def q_windows_files(spark, sf_dir):
    """Basic windows (T=10, label = any) on cleaned file-loaded frames, which have no time
    column: frames of an ID in the seeded shuffle order."""
    from canframes.operators import sequence as Q

    loaded = load_frames(spark, write_fixture(spark, sf_dir), partitioned=True)
    return Q.sequence_windows(Q.positions(loaded.frames), timesteps=10, label_rule="any")
