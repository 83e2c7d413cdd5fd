"""Frame views derived from the driver's ``events`` table (see FIXTURES.md §2), plus a
bench-size stand-in frame table from ``lineitem``.

Each view exists twice: as a Spark DataFrame (used by the operators) and as SQL text
that DuckDB runs as a CTE in the oracle queries. Both read the whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canframes.schema import ATTACK_FILES, BENIGN_FILE, FEATURES


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame per event: 20 IDs, 8 small-integer payload columns, label = error event."""
    e = events(spark, sf_dir)
    return e.select(
        F.col("event_id").alias("frame_id"),
        F.col("ts"),
        (F.col("user_id") % 20).cast("bigint").alias("ID"),
        F.floor(F.col("value") / 16.0).cast("int").alias("DATA_0"),
        F.length("event_type").cast("int").alias("DATA_1"),
        (F.col("user_id") % 4).cast("int").alias("DATA_2"),
        (F.hour("ts").cast("int") % 4).alias("DATA_3"),
        F.length("props").cast("int").alias("DATA_4"),
        (F.col("event_id") % 3).cast("int").alias("DATA_5"),
        F.lit(0).alias("DATA_6"),
        F.lit(255).alias("DATA_7"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
    )


def clean_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frames`` after read_and_clean + dropna: float32 payload, int label (no nulls occur)."""
    from canframes.functions.clean import drop_incomplete, read_and_clean

    return drop_incomplete(read_and_clean(frames(spark, sf_dir)))


# every frame_id divisible by the number gets this text as DATA_1 (the last that fits wins):
# not numbers, numbers with white space, and tokens that a CSV reader takes for missing
DIRTY_DATA_1 = {107: "1D", 109: "0F", 113: "0x1p3", 127: " 5 ", 131: "NA", 137: "NaN", 139: "null", 151: "1e1"}


def frames_raw(spark: SparkSession, sf_dir: str, with_source: bool = False) -> DataFrame:
    """Dirty text copy of ``frames`` (bad numbers, nulls, odd labels, descriptor columns);
    with ``with_source`` also the source file each row goes to (same projection, no join)."""
    f = frames(spark, sf_dir)
    fid = F.col("frame_id")
    data0 = (
        F.when(fid % 97 == 0, F.lit("bad"))
        .when(fid % 89 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("DATA_0").cast("string"))
    )
    data1 = F.col("DATA_1").cast("string")
    for divisor, text in DIRTY_DATA_1.items():
        data1 = F.when(fid % divisor == 0, F.lit(text)).otherwise(data1)
    label = (
        F.when(fid % 101 == 0, F.lit("unknown"))
        .when(fid % 103 == 0, F.lit("1.0"))
        .when((F.col("label") == 1) & (fid % 2 == 0), F.lit("ATTACK"))
        .when(F.col("label") == 1, F.lit("1"))
        .when(fid % 2 == 0, F.lit("Benign"))
        .otherwise(F.lit("0"))
    )
    return f.select(
        fid,
        F.when(fid % 149 == 0, F.lit("NA")).otherwise(F.col("ID").cast("string")).alias("ID"),
        data0.alias("DATA_0"),
        data1.alias("DATA_1"),
        *[F.col(c).cast("string").alias(c) for c in FEATURES[2:]],
        label.alias("label"),
        F.lit("x").alias("category"),
        F.lit("y").alias("specific_class"),
        *([source_of().alias("source")] if with_source else []),
    )


def source_of(label_col: str = "label") -> F.Column:
    """Which of the six source files a ``frames`` row is written to (CSV round trip):
    label 0 -> benign; label 1 split over the five attack files by DATA_2 / DATA_5."""
    d2, d5 = F.col("DATA_2").cast("string"), F.col("DATA_5").cast("string")
    attack = (
        F.when(d2 == "0", F.lit(ATTACK_FILES[0]))
        .when(d2 == "1", F.lit(ATTACK_FILES[1]))
        .when(d2 == "2", F.lit(ATTACK_FILES[2]))
        .when(d5 == "0", F.lit(ATTACK_FILES[3]))
        .otherwise(F.lit(ATTACK_FILES[4]))
    )
    return F.when(F.col(label_col) == 0, F.lit(BENIGN_FILE)).otherwise(attack)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long score table for two models: ``a`` in [0, 1] with many ties, ``b`` margins."""
    f = frames(spark, sf_dir)
    a = f.select(
        "frame_id",
        F.lit("a").alias("model"),
        "label",
        ((F.col("DATA_0") * 7 + F.col("DATA_1") * 3 + F.col("DATA_4")).cast("double") / 400.0).alias("score"),
    )
    b = f.select("frame_id", F.lit("b").alias("model"), "label", (F.col("DATA_1") - 6).cast("double").alias("score"))
    return a.unionByName(b)


# ---------------------------------------------------------------------------------------
# SQL text of the same views, for the DuckDB oracle (tables are pre-registered views).

FRAMES_SQL = """
SELECT event_id AS frame_id, ts, CAST(user_id % 20 AS BIGINT) AS ID,
       CAST(floor(value / 16.0) AS INT) AS DATA_0,
       CAST(length(event_type) AS INT) AS DATA_1,
       CAST(user_id % 4 AS INT) AS DATA_2,
       CAST(EXTRACT(HOUR FROM ts) AS INT) % 4 AS DATA_3,
       CAST(length(props) AS INT) AS DATA_4,
       CAST(event_id % 3 AS INT) AS DATA_5,
       0 AS DATA_6, 255 AS DATA_7,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label
FROM events
"""

CLEAN_SQL = (
    "SELECT frame_id, ts, ID, "
    + ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in FEATURES)
    + ", label FROM frames"
)

PAYLOAD_TEXT_SQL = "concat_ws(',', " + ", ".join(f"CAST(CAST({c} AS FLOAT) AS VARCHAR)" for c in FEATURES) + ")"
GROUP_KEY_SQL = f"sha1({PAYLOAD_TEXT_SQL})"

_DATA_1_SQL = "CASE " + " ".join(f"WHEN frame_id % {d} = 0 THEN '{t}'" for d, t in reversed(DIRTY_DATA_1.items())) + " ELSE CAST(DATA_1 AS VARCHAR) END AS DATA_1, "


def number_sql(c: str, to: str = "FLOAT") -> str:
    """DuckDB: text as a number in plain decimal or exponent form, else null."""
    return f"CASE WHEN regexp_full_match(trim({c}), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(trim({c}) AS {to}) END"


FRAMES_RAW_SQL = (
    "SELECT frame_id, CASE WHEN frame_id % 149 = 0 THEN 'NA' ELSE CAST(ID AS VARCHAR) END AS ID, "
    "CASE WHEN frame_id % 97 = 0 THEN 'bad' WHEN frame_id % 89 = 0 THEN NULL ELSE CAST(DATA_0 AS VARCHAR) END AS DATA_0, "
    + _DATA_1_SQL
    + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in FEATURES[2:])
    + ", CASE WHEN frame_id % 101 = 0 THEN 'unknown' WHEN frame_id % 103 = 0 THEN '1.0' "
    "WHEN label = 1 AND frame_id % 2 = 0 THEN 'ATTACK' WHEN label = 1 THEN '1' "
    "WHEN frame_id % 2 = 0 THEN 'Benign' ELSE '0' END AS label, "
    "'x' AS category, 'y' AS specific_class FROM frames"
)

SOURCE_SQL = (
    "CASE WHEN label = 0 THEN '{benign}' WHEN CAST(DATA_2 AS VARCHAR) = '0' THEN '{a0}' "
    "WHEN CAST(DATA_2 AS VARCHAR) = '1' THEN '{a1}' WHEN CAST(DATA_2 AS VARCHAR) = '2' THEN '{a2}' "
    "WHEN CAST(DATA_5 AS VARCHAR) = '0' THEN '{a3}' ELSE '{a4}' END"
).format(benign=BENIGN_FILE, a0=ATTACK_FILES[0], a1=ATTACK_FILES[1], a2=ATTACK_FILES[2], a3=ATTACK_FILES[3], a4=ATTACK_FILES[4])

SCORES_SQL = """
SELECT frame_id, 'a' AS model, label, CAST(DATA_0 * 7 + DATA_1 * 3 + DATA_4 AS DOUBLE) / 400.0 AS score FROM frames
UNION ALL
SELECT frame_id, 'b' AS model, label, CAST(DATA_1 - 6 AS DOUBLE) AS score FROM frames
"""


SPLIT_SQL = f"""
SELECT c.*, CASE WHEN r.rn <= r.k THEN 'test' ELSE 'train' END AS split
FROM (SELECT *, {GROUP_KEY_SQL} AS group_key FROM clean) c
JOIN (SELECT group_key, row_number() OVER (ORDER BY sha1('42:' || group_key)) AS rn,
             CEIL(0.2 * count(*) OVER ()) AS k
      FROM (SELECT DISTINCT {GROUP_KEY_SQL} AS group_key FROM clean) d) r USING (group_key)
"""

VIEWS = {
    "clean": CLEAN_SQL,
    "frames_raw": FRAMES_RAW_SQL,
    "scores": SCORES_SQL,
    "prepared": SPLIT_SQL,
}
VIEW_DEPS = {"prepared": ["clean"]}


def oracle(select: str, views: tuple[str, ...] | list[str] = (), ctes: tuple | list = ()) -> str:
    """An oracle query: ``frames`` and the named views as CTEs, then extra ``(name, sql)``
    CTEs in order, then the final SELECT."""
    order: list[str] = []
    for v in views:
        for d in VIEW_DEPS.get(v, []) + [v]:
            if d not in order:
                order.append(d)
    parts = [f"frames AS ({FRAMES_SQL})"] + [f"{v} AS ({VIEWS[v]})" for v in order] + [f"{n} AS ({s})" for n, s in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + select


def frames_raw_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frames_raw`` plus the source file each row is written to (CSV round trip)."""
    return frames_raw(spark, sf_dir, with_source=True)


SRC_SQL = f"SELECT frame_id, {SOURCE_SQL} AS source FROM frames"
SOURCE_RANK_SQL = (
    "CASE source "
    + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(ATTACK_FILES + [BENIGN_FILE]))
    + " END"
)


def line_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bench-size stand-in frame table from ``lineitem`` (one frame per order line): 20 IDs
    by supplier, time = ship date, small-integer payload, label = returned line."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    flag = F.col("l_returnflag")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("frame_id"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_suppkey") % 20).cast("bigint").alias("ID"),
        F.round("l_quantity").cast("int").alias("DATA_0"),
        F.col("l_linenumber").cast("int").alias("DATA_1"),
        F.round(F.col("l_discount") * 100).cast("int").alias("DATA_2"),
        F.round(F.col("l_tax") * 100).cast("int").alias("DATA_3"),
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("DATA_4"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("DATA_5"),
        F.lit(0).alias("DATA_6"),
        F.lit(255).alias("DATA_7"),
        F.when(flag == "R", 1).otherwise(0).alias("label"),
    )


LINE_FRAMES_SQL = """
SELECT l_orderkey * 8 + l_linenumber AS frame_id, l_shipdate AS ts, CAST(l_suppkey % 20 AS BIGINT) AS ID,
       CAST(round(l_quantity) AS INT) AS DATA_0, CAST(l_linenumber AS INT) AS DATA_1,
       CAST(round(l_discount * 100) AS INT) AS DATA_2, CAST(round(l_tax * 100) AS INT) AS DATA_3,
       CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS DATA_4,
       CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS DATA_5, 0 AS DATA_6, 255 AS DATA_7,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
FROM lineitem
"""
