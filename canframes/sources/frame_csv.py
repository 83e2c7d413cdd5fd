"""Frame CSV sources: one benign and five attack files, class decided by the file.

Row order inside a file matters (synthetic IDs, stable sorts), so every scanned row gets
its file-order position without a single-task numbering. Each file is scanned once: rows
are landed as Parquet together with the coordinates of that scan (``_metadata.file_path``,
``file_block_start`` and ``monotonically_increasing_id``, consecutive inside a split), so
nothing depends on a later scan being cut the same way. Rows are then counted per split of
the landed copy, split offsets are prefix sums over that small table, and the position
inside a split is the distance from the split's first id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canframes.functions.clean import drop_incomplete, missing_tokens_to_null, read_and_clean
from canframes.operators.positions import join_small
from canframes.session import land
from canframes.schema import (
    ATTACK_FILES,
    BENIGN_FILE,
    CLASS_POS_COL,
    FEATURES,
    FRAME_SEQ_COL,
    SOURCE_COL,
    SOURCE_RANK_COL,
)

_META = ["_file", "_blk0", "_mid"]


def scan_csv(spark: SparkSession, path: str, source: str, rank: int) -> DataFrame:
    """All columns as text (no inference), plus source name / rank and scan coordinates."""
    df = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    return df.select(
        *[missing_tokens_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns],
        F.lit(source).alias(SOURCE_COL),
        F.lit(rank).alias(SOURCE_RANK_COL),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_blk0"),
        F.monotonically_increasing_id().alias("_mid"),
    )


def with_file_positions(df: DataFrame, group_col: str | None = None) -> DataFrame:
    """``frame_seq`` = position inside the source; ``class_pos`` = position inside the
    concatenation of the sources (in rank order) of the same ``group_col`` value."""
    df = land(df, "csv-scan")
    keys = [SOURCE_RANK_COL, "_file", "_blk0"]
    grp = [group_col] if group_col else []
    splits = df.groupBy(*grp, *keys).agg(F.count(F.lit(1)).alias("_c"), F.min("_mid").alias("_m0"))
    in_src = Window.partitionBy(*grp, SOURCE_RANK_COL).orderBy("_file", "_blk0").rowsBetween(Window.unboundedPreceding, -1)
    in_cls = Window.partitionBy(*grp).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    # one row per input split (~400k at 100 TB with 256 MB splits), each with a file path;
    # broadcast behind the size check, so the data itself is not shuffled for the join
    splits = land(
        splits.select(
            *grp, *keys, "_m0", "_c",
            F.coalesce(F.sum("_c").over(in_src), F.lit(0)).alias("_os"),
            F.coalesce(F.sum("_c").over(in_cls), F.lit(0)).alias("_oc"),
        ),
        "csv-splits",
    )
    known = splits.agg(F.count(F.lit(1)), F.max(F.length("_file"))).first()
    j = join_small(df, splits.drop("_c"), grp + keys, "inner", known[0], 64 + 2 * (known[1] or 0))
    local = F.col("_mid") - F.col("_m0")
    return j.withColumn(FRAME_SEQ_COL, F.col("_os") + local).withColumn(CLASS_POS_COL, F.col("_oc") + local).drop(
        *_META, "_m0", "_os", "_oc"
    )


def source_paths(data_dir: str, partitioned: bool = False) -> list[tuple[str, str, int]]:
    """(source name, path, rank): attack files in concatenation order, then benign."""
    fmt = (lambda n: f"{data_dir}/source={n}") if partitioned else (lambda n: f"{data_dir}/{n}")
    names = ATTACK_FILES + [BENIGN_FILE]
    return [(n, fmt(n), i) for i, n in enumerate(names)]


def scan_class(spark: SparkSession, sources: list[tuple[str, str, int]]) -> DataFrame:
    """Union of the given files (missing columns become null) with file positions."""
    parts = [scan_csv(spark, p, n, r) for n, p, r in sources]
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.unionByName(p, allowMissingColumns=True)
    return with_file_positions(raw)


@dataclass
class LoadedFrames:
    frames: DataFrame  # attack then benign, after any-null row drop
    attack_df: DataFrame  # cleaned, before the row drop
    benign_df: DataFrame


def load_frames(spark: SparkSession, data_dir: str, features: list[str] | None = None, partitioned: bool = False) -> LoadedFrames:
    """Read the six files, label by file (overwriting any label column), clean each class
    separately (so synthetic IDs restart per class), union attack first, drop incomplete
    rows. ``frame_id`` = source rank * 2**40 + position in the source."""
    features = features or FEATURES
    srcs = source_paths(data_dir, partitioned)
    attack = scan_class(spark, [s for s in srcs if s[0] != BENIGN_FILE]).withColumn("label", F.lit(1))
    benign = scan_class(spark, [s for s in srcs if s[0] == BENIGN_FILE]).withColumn("label", F.lit(0))
    key = (F.col(SOURCE_RANK_COL).cast("long") * F.lit(1 << 40) + F.col(FRAME_SEQ_COL)).alias("frame_id")
    attack_df = read_and_clean(attack, features).withColumn("frame_id", key)
    benign_df = read_and_clean(benign, features).withColumn("frame_id", key)
    both = attack_df.unionByName(benign_df, allowMissingColumns=True)
    return LoadedFrames(drop_incomplete(both), attack_df, benign_df)


def combined_order(raw: DataFrame, benign_first: bool = True) -> DataFrame:
    """Global row number of the union of all files (benign first by default): per-source
    counts (six rows) give the offsets, ``frame_seq`` the rest."""
    rank = F.when(F.col(SOURCE_COL) == BENIGN_FILE, F.lit(-1)).otherwise(F.col(SOURCE_RANK_COL)) if benign_first else F.col(SOURCE_RANK_COL)
    r = raw.withColumn("_ord", rank)
    counts = r.groupBy("_ord").agg(F.count(F.lit(1)).alias("_c"))
    offs = counts.select("_ord", F.coalesce(F.sum("_c").over(Window.orderBy("_ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return r.join(F.broadcast(offs), "_ord").withColumn("row_seq", F.col("_o") + F.col(FRAME_SEQ_COL)).drop("_ord", "_o")


def write_source_files(df: DataFrame, out_dir: str, source_col: str = SOURCE_COL, order_col: str = "frame_id", drop: list[str] | None = None) -> None:
    """Write one CSV dataset per source under ``out_dir/source=<name>/``, rows in
    ``order_col`` order (range partitioning keeps part files in order; no single task)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, source_col, order_col).sortWithinPartitions(source_col, order_col)
    ordered.drop(*(drop or [])).write.mode("overwrite").partitionBy(source_col).option("header", True).csv(out_dir)


def write_ordered_csv(df: DataFrame, out_dir: str, order_col: str) -> None:
    """One CSV dataset whose part files, read in name order, hold the rows in order."""
    df.orderBy(order_col).drop(order_col).write.mode("overwrite").option("header", True).csv(out_dir)
