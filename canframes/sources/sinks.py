"""Sinks for fitted artifacts: metrics table, thresholds / metadata JSON, importances,
coefficients, fitted parameter tables and model directories.

All outputs are small (one row per model or per feature) except where noted; each is a
DataFrame write, so the path may be any shared file system the cluster uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canframes.schema import FEATURES


def write_table_csv(df: DataFrame, path: str) -> None:
    """A small result table (bounded rows) as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_ordered_csv(df: DataFrame, path: str, *order: str) -> None:
    """A table of any size as CSV parts with headers, dealt out by ranges: rows ascend in
    ``order`` within a part and from part to part (by file name)."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    write_table_csv(metrics, path)


def write_importances(table: DataFrame, path: str) -> None:
    write_table_csv(table.orderBy(F.desc("importance"), "feature"), path)


def write_coefficients(table: DataFrame, path: str) -> None:
    write_table_csv(table.select("feature", "coef"), path)


THRESHOLDS_SCHEMA = T.StructType(
    [
        T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField(
            "models",
            T.MapType(T.StringType(), T.StructType([T.StructField("thr_default", T.DoubleType()), T.StructField("thr_bestF1", T.DoubleType())])),
        ),
        T.StructField("notes", T.StringType()),
    ]
)


def thresholds_frame(evaluated: DataFrame, notes: str, features: list[str] | None = None, key_col: str = "key") -> DataFrame:
    """One struct row {features[], models{key: {thr_default, thr_bestF1}}, notes} from the
    per-model evaluation rows (one row per model)."""
    features = features or FEATURES
    entries = evaluated.select(F.col(key_col).alias("k"), F.struct(F.col("thr_default").cast("double").alias("thr_default"), F.col("thr_bestF1").cast("double").alias("thr_bestF1")).alias("v"))
    return entries.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("models")).select(
        F.array(*[F.lit(f) for f in features]).alias("features"), "models", F.lit(notes).alias("notes")
    )


def write_json_row(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_params(df: DataFrame, path: str) -> None:
    """Fitted parameter table (a few rows per feature / class) as Parquet."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def read_json_row(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(THRESHOLDS_SCHEMA).json(path)
