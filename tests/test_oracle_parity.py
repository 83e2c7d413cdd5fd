"""Every registered query with an oracle equals its DuckDB SQL on the smoke tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SMOKE
from tools.oracle_check import digest

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


def test_every_query_has_callable():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 60


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SMOKE)
    scols, srows = sdf.columns, [tuple(r) for r in sdf.collect()]
    rel = duck.sql(ORACLES[name])
    ocols, orows = rel.columns, rel.fetchall()
    assert sorted(scols) == sorted(ocols)
    assert len(srows) == len(orows)
    hs, ls = digest(scols, srows)
    ho, lo = digest(ocols, orows)
    assert hs == ho, (sorted(set(ls) - set(lo))[:3], sorted(set(lo) - set(ls))[:3])


def test_entry_runs(spark):
    df = entry.entry(spark)
    out = df.collect()
    assert len(out) == 3 and {r["split"] for r in out} == {"train", "test", "all"}
