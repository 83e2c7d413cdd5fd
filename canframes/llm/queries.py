"""The registered queries of this subpackage (production parameters, whole tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canframes.llm import decontaminate, infill, language, licenses, linedup, ngramjoin, periodic, pieces, pii, quality, quotes, secrets, simhash
from canframes.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return add


@_query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_columns(pii.find_personal_data(table(spark, sf_dir, "documents")))


@_query("op2_chat_formatting", quotes.ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.reply_ordered(table(spark, sf_dir, "conversations"))


@_query("op3_license_scans", licenses.oracle())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


@_query("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


@_query("op5_quality_rules")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.apply_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


@_query("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@_query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    teach = docs.filter(~language.held_out() & F.col("doc_id").isNotNull())
    found = language.identify(docs, language.fit_language(teach))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@_query("op8_secret_scans")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_columns(secrets.find_secrets(table(spark, sf_dir, "documents")))


@_query("op9_benchmark_decontamination", decontaminate.ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op10_line_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("removed_lines").cast("long").alias("n_removed"), F.array_join("removed_lines", ",").alias("removed"), "text")


@_query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_columns(periodic.find_runs(table(spark, sf_dir, "documents"), words=periodic.with_periodic_tail))


@_query("op12_fill_in_middle", infill.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest_columns(infill.fill_in_middle(table(spark, sf_dir, "documents")))


@_query("op13_ngram_jaccard")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_documents(table(spark, sf_dir, "documents"))


@_query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
