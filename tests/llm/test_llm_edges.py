"""Defined results of every operator on empty tables and awkward rows."""

import pytest
from helpers import awkward

from canframes.llm import decontaminate, language, licenses, linedup, pieces, pii, quality, quotes, secrets, simhash

PER_ROW = {
    "pii": lambda d: pii.span_columns(pii.find_personal_data(d)),
    "licenses": licenses.find_licenses,
    "pieces": pieces.encode,
    "quality": lambda d: quality.apply_quality(d, quality.fit_quality(d, d.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality", "n_chars AS toxic"))),
    "simhash": simhash.simhash_groups,
    "language": lambda d: language.identify(d, language.fit_language(d)),
    "secrets": lambda d: secrets.span_columns(secrets.find_secrets(d)),
    "decontaminate": lambda d: decontaminate.find_leaks(d, d.selectExpr("doc_id AS item_id", "text").filter("doc_id < 3")),
    "linedup": linedup.dedup_lines,
    "quotes": lambda d: quotes.link_quotes(d.selectExpr("doc_id AS conv_id", "n_chars AS turn", "lang AS role", "text", "h AS key", "score AS level")),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_awkward_rows_each_get_a_result(spark, name):
    d = awkward(spark)
    assert len(PER_ROW[name](d).collect()) == d.count()


@pytest.mark.parametrize("name", PER_ROW)
def test_an_empty_table_gives_no_rows(spark, name):
    assert PER_ROW[name](awkward(spark).limit(0)).collect() == []


def test_repeated_rows_give_repeated_results(spark):
    rows = [(r.doc_id, r.spans) for r in PER_ROW["pii"](awkward(spark)).collect() if r.doc_id == 3]
    assert len(rows) == 3


def test_line_dedup_passes_clashing_columns_through(spark):
    d = awkward(spark)
    out = linedup.dedup_lines(d)
    assert out.columns == [*d.columns, "removed_lines"]
    assert {r.h for r in out.collect()} == {r.h for r in d.collect()}


def test_filters_keep_their_columns(spark):
    d = awkward(spark)
    assert decontaminate.drop_contaminated(d, d.selectExpr("doc_id AS item_id", "text").limit(0)).columns == d.columns
    kept = simhash.keep_one_of_each_group(d)
    assert kept.columns == d.columns
    assert kept.filter("text = 'a b c d e f g'").count() == 1
    assert quality.keep_good(d, quality.QualityModel(None)).columns == d.columns


def test_decontamination_without_benchmark(spark):
    d = awkward(spark)
    out = decontaminate.find_leaks(d, d.selectExpr("doc_id AS item_id", "text").limit(0)).collect()
    assert not any(r.contaminated for r in out)
