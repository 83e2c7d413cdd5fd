"""The corpus pipeline over a ``documents`` table.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and works on all rows
its predecessor kept. All but the last return the columns of ``documents``; the last returns
the piece ids of what is left. A stage's result is written as Parquet and read again, which
cuts the lineage, so a lost executor repeats tasks of one stage only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canframes.llm import decontaminate, linedup, pieces, quality, simhash
from canframes.llm.common import DOCUMENT_COLUMNS, table
from canframes.session import land


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model).select(DOCUMENT_COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common blocks go from the later documents; one that loses all its words goes."""
    out = linedup.dedup_lines(docs)
    left = (F.size("removed_lines") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return out.filter(left).withColumn("n_chars", F.length("text").cast("long")).select(DOCUMENT_COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one_of_each_group(docs).select(DOCUMENT_COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(DOCUMENT_COLUMNS)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids and whether decoding them gives the text back."""
    return pieces.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding", sentencepiece_encoding),
]

#: the stages hold a trained model, patience alignment and graph components: no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = land(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
