"""The piece tables of the lattice need no Python worker on the executors."""

from __future__ import annotations

from canframes.llm.pieces import _small_table


def test_small_table_is_a_local_relation(spark):
    rows = [("ab", 0), ("▁ö", 1), ("", 2)]
    df = _small_table(spark, rows, "piece", "place")
    assert sorted(tuple(r) for r in df.collect()) == sorted(rows)
    assert df.schema.simpleString() == "struct<piece:string,place:int>"
    assert "LocalRelation" in df._jdf.queryExecution().optimizedPlan().toString()
    assert _small_table(spark, [], "head", "reach").count() == 0
