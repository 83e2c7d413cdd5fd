"""Cleaning of frame tables: descriptor drop, required-column check, numeric coercion,
label normalization, synthetic IDs and null handling (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canframes.schema import (
    CLASS_POS_COL,
    DESCRIPTOR_COLUMNS,
    FEATURES,
    LABEL_TEXT_MAP,
    MISSING_TOKENS,
    SYNTHETIC_ID_BLOCK,
    SYNTHETIC_ID_PREFIX,
)


# what the cast takes beyond decimal and exponent forms and inf: type suffixes, hexadecimal
# forms, nan, and control characters around a number
_NOT_DECIMAL = r"[\x00-\x08\x0E-\x1FdDpPxX]|[0-9.][fF]|[nN][aA]"


def parse_number(c: str | Column, to: str = "float") -> Column:
    """Text as a number: decimal or exponent form (or inf) with white space around it
    allowed; anything else, such as ``1D``, ``0F`` or ``0x1p3``, is null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(~col.rlike(_NOT_DECIMAL), col.try_cast(to))


def to_float32(c: str | Column, is_text: bool = True) -> Column:
    """Numeric coercion: unparseable text -> null (not an error), NaN -> null, float32."""
    col = F.col(c) if isinstance(c, str) else c
    if is_text:
        return parse_number(col)  # never NaN
    v = col.try_cast("float")
    return F.when(~F.isnan(v), v)


def missing_tokens_to_null(c: str | Column) -> Column:
    """Text that a CSV reader takes for a missing value -> null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(~col.isin(MISSING_TOKENS), col)


def normalize_label(c: str | Column = "label") -> Column:
    """Lower-cased text of the label mapped benign/0 -> 0 and attack/1 -> 1; else null.

    No trimming; "1.0" is not mapped (the text of a float label)."""
    col = F.col(c) if isinstance(c, str) else c
    txt = F.lower(col.cast("string"))
    out = F.lit(None).cast("int")
    for text, value in LABEL_TEXT_MAP.items():
        out = F.when(txt == F.lit(text), F.lit(value)).otherwise(out)
    return out


def synthetic_id(pos: str | Column = CLASS_POS_COL) -> Column:
    """``gid_<position // 50>`` for tables without an ID column."""
    col = F.col(pos) if isinstance(pos, str) else pos
    return F.concat(F.lit(SYNTHETIC_ID_PREFIX), F.floor(col / F.lit(SYNTHETIC_ID_BLOCK)).cast("string"))


def require_columns(df: DataFrame, features: list[str] | None = None) -> None:
    features = features or FEATURES
    missing = [c for c in features + ["label"] if c not in df.columns]
    if missing:
        raise ValueError(f"the frame table lacks the columns {missing}")


def read_and_clean(df: DataFrame | str, features: list[str] | None = None, position_col: str = CLASS_POS_COL) -> DataFrame:
    """Clean one frame table (before the any-null row drop). ``df`` is a DataFrame or a
    CSV path (read as text with file-order positions).

    ``position_col`` is the 0-based row position used to build ``gid_`` ids when the
    table has no ``ID`` column; it is produced by the CSV source (file order)."""
    features = features or FEATURES
    if isinstance(df, str):
        from pyspark.sql import SparkSession

        from canframes.sources.frame_csv import scan_csv, with_file_positions

        spark = SparkSession.getActiveSession()
        df = with_file_positions(scan_csv(spark, df, df.rstrip("/").split("/")[-1], 0))
    df = df.drop(*[c for c in DESCRIPTOR_COLUMNS if c in df.columns])
    require_columns(df, features)
    cols = []
    for name in df.columns:
        if name in features:
            cols.append(to_float32(F.col(f"`{name}`"), df.schema[name].dataType.typeName() == "string").alias(name))
        elif name == "label":
            cols.append(normalize_label("label").alias("label"))
        else:
            cols.append(F.col(name))
    out = df.select(*cols)
    if "ID" not in out.columns:
        if position_col not in out.columns:
            raise ValueError("table has no ID column and no row position to build synthetic ids from")
        out = out.withColumn("ID", synthetic_id(position_col))
    return out


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with a null (or NaN) in any column."""
    return df.na.drop(how="any")


def fill_zero(df: DataFrame) -> DataFrame:
    """Fill every null with 0: numeric columns with 0.0, label with 0, text with '0.0'."""
    out = df.na.fill(0.0)
    text_cols = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    if text_cols:
        out = out.na.fill("0.0", subset=text_cols)
    return out


def typed_projection(df: DataFrame, features: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Features as float32, target as int32, plus carried key columns."""
    features = features or FEATURES
    keep = keep or []
    return df.select(*keep, *[F.col(c).cast("float").alias(c) for c in features], F.col("label").cast("int").alias("label"))
