"""Leakage-safe grouped splits, class statistics and leakage audits.

The grouped split takes exactly ceil(f * G) of the G groups for test, ordered by a seeded
sha1 of the group key. The k-th smallest hash is found without a global sort or a
one-task window over all groups: a histogram over the first hex digits of the hash
(16**4 rows at most, a bounded summary) locates the bucket holding position k, and only that bucket
(about G / 65536 groups) is ranked. The distinct group hashes are checkpointed once to
the shared folder, so the count and the cuts never rescan the frames; every row is then
labelled in place by ``hash <= cut`` (a literal): no join back, no shuffle of the frames.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canframes.functions.hashing import row_hash, salted_hash
from canframes.schema import GROUP_KEY_COL, SEED, SPLIT_COL, TEST_SIZE
from canframes.session import land

_H = "_split_hash"
PREFIX_DIGITS = 4
RANKED_ROWS = 1 << 20  # hashes that one task ranks


def with_group_key(df: DataFrame, features: list[str] | None = None, out: str = GROUP_KEY_COL) -> DataFrame:
    return df.withColumn(out, row_hash(features))


def prefix_histogram(hashes: DataFrame, col: str = _H, digits: int = PREFIX_DIGITS) -> list[tuple[str, int]]:
    """Counts of the distinct hashes per leading hex prefix, in prefix order: a bounded
    summary (at most 16**digits rows) computed by one aggregate."""
    pref = F.substring(F.col(col), 1, digits)
    rows = hashes.groupBy(pref.alias("_p")).agg(F.count(F.lit(1)).alias("_c")).collect()
    return sorted((r["_p"], int(r["_c"])) for r in rows)


def kth_smallest(hashes: DataFrame, k: int, hist: list[tuple[str, int]], col: str = _H, digits: int = PREFIX_DIGITS) -> str:
    """The k-th smallest (1-based) of the distinct hex strings in ``hashes``; '' for k = 0.

    The histogram locates the prefix bucket holding rank k; while that bucket is larger
    than one task should rank, a histogram of the next digits narrows it down."""
    if k <= 0:
        return ""
    bucket, length = hashes.select(col), digits
    while True:
        before = 0
        for prefix, count in hist:
            if before + count >= k:
                break
            before += count
        k -= before
        bucket = bucket.filter(F.substring(F.col(col), 1, length) == F.lit(prefix))
        if count <= RANKED_ROWS:
            break
        length += digits
        hist = prefix_histogram(bucket, col, length)
    ranked = bucket.withColumn("_rn", F.row_number().over(Window.orderBy(col)))
    return ranked.filter(F.col("_rn") == k).first()[col]


@dataclass(frozen=True)
class SplitRule:
    """A fitted grouped split: hash cuts in seeded sha1 order of the group key.

    test = first ceil(test_size * G) groups; with ``val_size`` val = the next
    ceil(val_size * (G - n_test)) groups; the rest is train."""

    group_col: str
    seed: int
    n_groups: int
    cut_test: str
    cut_val: str | None = None

    @classmethod
    def fit(cls, groups_from: DataFrame, group_col: str = GROUP_KEY_COL, test_size: float = TEST_SIZE, val_size: float | None = None, seed: int = SEED) -> "SplitRule":
        # the distinct group hashes are written once to the shared checkpoint folder;
        # their prefix histogram gives G and locates each cut; one small job per cut
        hashes = land(groups_from.select(salted_hash(group_col, seed).alias(_H)).distinct(), "group-hashes")
        hist = prefix_histogram(hashes)
        g = sum(c for _, c in hist)
        k_test = math.ceil(float(test_size) * g)
        cut_val = None
        if val_size is not None:
            cut_val = kth_smallest(hashes, k_test + math.ceil(float(val_size) * (g - k_test)), hist)
        return cls(group_col, seed, g, kth_smallest(hashes, k_test, hist), cut_val)

    def column(self) -> Column:
        h = salted_hash(self.group_col, self.seed)
        label = F.when(h <= F.lit(self.cut_test), F.lit("test"))
        if self.cut_val is not None:
            label = label.when(h <= F.lit(self.cut_val), F.lit("val"))
        return label.otherwise(F.lit("train"))


def split_column(
    groups_from: DataFrame,
    group_col: str = GROUP_KEY_COL,
    test_size: float = TEST_SIZE,
    val_size: float | None = None,
    seed: int = SEED,
) -> Column:
    """The fitted split rule as a column: groups (and their count G) come from
    ``groups_from``; the column labels any table that has ``group_col``."""
    return SplitRule.fit(groups_from, group_col, test_size, val_size, seed).column()


def group_split(
    df: DataFrame,
    group_col: str = GROUP_KEY_COL,
    test_size: float = TEST_SIZE,
    val_size: float | None = None,
    seed: int = SEED,
    out: str = SPLIT_COL,
) -> DataFrame:
    """Label each row train / test (/ val) so that no group lands on two sides."""
    return df.withColumn(out, split_column(df, group_col, test_size, val_size, seed))


def hash_row_split(df: DataFrame, key_col: str, test_size: float = TEST_SIZE, seed: int = SEED, out: str = SPLIT_COL) -> DataFrame:
    """Naive row-level split (ignores groups): test when the seeded hash of the row key
    falls in the first ``test_size`` of the 32-bit hash space. Used to show leakage."""
    cut = format(int(test_size * 16**8), "08x")
    h8 = F.substring(salted_hash(key_col, seed), 1, 8)
    return df.withColumn(out, F.when(h8 < F.lit(cut), F.lit("test")).otherwise(F.lit("train")))


def split_summary(df: DataFrame, group_col: str = GROUP_KEY_COL, split_col: str = SPLIT_COL) -> DataFrame:
    """Rows, positives, positive share and groups per split, plus an ``all`` row. Rows are
    counted per (split, group) first, so the rollup and its distinct count see one row per
    group instead of every frame."""
    per_group = df.groupBy(split_col, group_col).agg(F.count(F.lit(1)).alias("_n"), F.sum("label").cast("bigint").alias("_p"))
    return (
        per_group.rollup(split_col)
        .agg(F.sum("_n").alias("n_rows"), F.sum("_p").alias("n_pos"), F.countDistinct(group_col).alias("n_groups"))
        .select(
            F.coalesce(F.col(split_col), F.lit("all")).alias(split_col),
            "n_rows",
            "n_pos",
            F.round(F.col("n_pos").cast("double") / F.col("n_rows"), 9).alias("pos_share"),
            "n_groups",
        )
    )


def class_counts(df: DataFrame, split_col: str = SPLIT_COL) -> DataFrame:
    return df.groupBy(split_col, "label").agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Balanced weights n / (n_classes * n_class) on the given (train) rows."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()  # at most a handful of class rows
    return counts.select(
        label_col,
        "n",
        (F.sum("n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("n"))).alias("weight"),
    )


def with_class_weight(df: DataFrame, weights: DataFrame, label_col: str = "label", out: str = "weight") -> DataFrame:
    """Attach the class weight to each row (the class table has one row per class)."""
    return df.join(F.broadcast(weights.select(label_col, F.col("weight").alias(out))), label_col, "left")


def group_overlap(df: DataFrame, a: str = "train", b: str = "test", group_col: str = GROUP_KEY_COL, split_col: str = SPLIT_COL) -> DataFrame:
    """Number of groups present on both sides (must be 0), in one aggregation pass."""
    per_group = df.groupBy(group_col).agg(
        F.max((F.col(split_col) == a).cast("int")).alias("_a"), F.max((F.col(split_col) == b).cast("int")).alias("_b")
    )
    return per_group.agg(F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("n_overlap"))


def exact_dups(df: DataFrame, group_col: str = GROUP_KEY_COL, split_col: str = SPLIT_COL, train: str = "train", test: str = "test") -> DataFrame:
    """Test rows whose payload also occurs in train, and all test rows (one pass, no join)."""
    per_group = df.groupBy(group_col).agg(
        F.count_if(F.col(split_col) == train).alias("_tr"), F.count_if(F.col(split_col) == test).alias("_te")
    )
    return per_group.agg(
        F.coalesce(F.sum(F.when(F.col("_tr") > 0, F.col("_te"))), F.lit(0)).cast("bigint").alias("n_dup"),
        F.coalesce(F.sum("_te"), F.lit(0)).cast("bigint").alias("n_test"),
    )


def leakage_audit(df: DataFrame, group_col: str = GROUP_KEY_COL, split_col: str = SPLIT_COL, train: str = "train", test: str = "test") -> DataFrame:
    """One row: groups on both sides, test rows whose payload occurs in train, test rows
    (one grouping pass)."""
    per_group = df.groupBy(group_col).agg(
        F.count_if(F.col(split_col) == train).alias("_tr"), F.count_if(F.col(split_col) == test).alias("_te")
    )
    return per_group.agg(
        F.count_if((F.col("_tr") > 0) & (F.col("_te") > 0)).alias("n_overlap"),
        F.coalesce(F.sum(F.when(F.col("_tr") > 0, F.col("_te"))), F.lit(0)).cast("bigint").alias("n_dup"),
        F.coalesce(F.sum("_te"), F.lit(0)).cast("bigint").alias("n_test"),
    )


def distinct_counts(df: DataFrame, cols: list[str], exact: bool = True, rsd: float = 0.01) -> DataFrame:
    """One row: number of distinct values of each column (exact, or HyperLogLog++ with
    relative standard deviation ``rsd``), all in one pass."""
    agg = (lambda c: F.countDistinct(c)) if exact else (lambda c: F.approx_count_distinct(c, rsd))
    return df.agg(*[agg(c).alias(f"n_{c}") for c in cols])


def distinct_sketches(df: DataFrame, cols: list[str], by: list[str], lg_k: int = 14) -> DataFrame:
    """One row per value of ``by`` (a file, a day) with a HyperLogLog sketch of each column, at
    most 2^lg_k bytes each: a table to store, so that later counts over any of its rows need no
    second scan. Nulls are not counted."""
    return df.groupBy(*by).agg(*[F.hll_sketch_agg(F.col(f"`{c}`").cast("string"), lg_k).alias(c) for c in cols])


def merged_distinct(sketches: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Distinct values of each column over the rows of a sketch table (or its groups): a value
    in several sketches counts once. Relative standard error 1.04 / sqrt(2^lg_k) at most."""
    agg = [F.hll_sketch_estimate(F.hll_union_agg(c, True)).alias(f"n_{c}") for c in cols]
    return sketches.groupBy(*(by or [])).agg(*agg)


def assert_no_overlap(df: DataFrame, **kw) -> None:
    n = group_overlap(df, **kw).first()["n_overlap"]
    if n:
        raise AssertionError(f"group leakage: {n} groups on both sides")
