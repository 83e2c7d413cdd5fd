"""The corpus pipeline and the registration of the queries."""

import sys

from helpers import SMOKE

from canframes.llm.common import DOCUMENT_COLUMNS, table


def test_stages_and_run(spark):
    import corpus_pipeline as p

    docs = table(spark, SMOKE, "documents")
    counts = [docs.count()]
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SMOKE)
        assert docs.columns == DOCUMENT_COLUMNS
        rows = docs.collect()
        counts.append(len(rows))
        docs = spark.createDataFrame(rows, docs.schema)
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < counts[0]
    assert all(r.n_chars == len(r.text) for r in rows)
    last = p.STAGES[-1][1](spark, docs, SMOKE).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in rows) and all(r.round_trip for r in last)
    run = {r.doc_id: r.ids for r in p.run(spark, SMOKE).collect()}
    assert run == {r.doc_id: r.ids for r in last}


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert {"op2_chat_formatting", "op3_license_scans", "op9_benchmark_decontamination"} <= set(e.oracle_sql())


def test_entry_without_the_subpackage(monkeypatch):
    import importlib.util

    import __spark_entry__ as e

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name == "corpus_pipeline" else real(name, *a))
    assert not any(n.startswith("op1_") or n == "pipeline" for n in e.queries())
    assert "helpers" in sys.modules
