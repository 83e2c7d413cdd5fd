"""Units are cut and hashed by arrays, and their best paths are found by batches, not in a fold by unit."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from canframes.llm import pieces

ODD = "ab▁ É×÷ɏɐȿɀÿ¿ʰЖ你␣▂•—\U0001d518́\x00\n9.\t\x7f\x80߿ࠀ"
MIXED = pieces.PieceTable([("▁a", 1, -1.0), ("a.b", 2, -2.0)], None, 0)
TIES = pieces.PieceTable([("a", 1, -1.0), ("aa", 2, -2.0), ("aaa", 3, -3.0), ("▁", 4, 0.0), ("b", 5, -1.5)], None, 9)


def _frame(spark, units):
    return spark.createDataFrame([(u, pieces.unit_hash(u), 1) for u in units], "unit string, h long, n long")


def _hash(unit):
    values, base, raw = pieces._byte_values().tolist(), int(pieces._BASE), unit.encode()
    h = sum(values[b] * pow(base, i, 1 << 64) for i, b in enumerate(raw)) % (1 << 64)
    h = (h ^ (h >> 32) ^ len(raw)) * int(pieces._MIX) % (1 << 64)
    h ^= h >> 29
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize("table", [None, MIXED, TIES])
def test_units_are_those_of_the_pattern(table):
    table = table or pieces.load_pieces()
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(2000)] + [None, "", "a" * 9000 + "1" * 5000 + " b"]
    want = [re.findall(table.unit_pattern(), "▁" + t.replace(" ", "▁")) if t else [] for t in texts]
    cut = pieces.Units(table)
    found = cut(pa.array(texts))
    units = [u for x in want for u in x]
    assert found.strings(np.arange(len(units))).to_pylist() == units
    assert found.ends.tolist() == np.cumsum([len(x) for x in want]).tolist()
    known = {u: _hash(u) for u in units}
    assert found.hashes.tolist() == [known[u] for u in units]
    part = cut(pa.array(texts).slice(5, 40))
    assert part.strings(np.arange(len(part.sizes))).to_pylist() == [u for x in want[5:45] for u in x]
    assert len(cut(pa.array([None, ""], pa.string())).sizes) == len(cut(pa.array([], pa.string())).sizes) == 0


@pytest.mark.parametrize("table", [None, TIES])
def test_paths_by_batches_are_those_of_the_fold(spark, table, monkeypatch):
    monkeypatch.setattr(pieces, "_EDGES", 50)  # many slices of a batch
    table = table or pieces.load_pieces()
    rng = random.Random(3)
    units = {"▁" + "".join(rng.choice(rng.choice(["ab", "abcdehtéing", ODD.replace("▁", "")])) for _ in range(rng.randint(0, 62))) for _ in range(150)}
    units |= {"你", "\U0001d518", "▁▁▁", "a" * 64, "b" * 65, "▁" + "ab" * 200, "1" * 100 + "你"}
    frame = _frame(spark, sorted(units))
    got = {r.unit: list(r.ids) for r in pieces.segment(frame, table).collect()}
    useful = table.useful()
    scores = pieces._constants([table.unknown_score, *[s for _, _, s in useful]], "double")
    codes = pieces.lattice(frame, table).select("unit", pieces.short_path(F.col("edges"), F.length("unit"), scores).alias("path")).collect()
    assert len(codes) == len(got) == len(units)
    for r in codes:
        want = []
        for c in r.path:
            place, char = c & ((1 << 24) - 1), r.unit[(c >> 32) - 1]
            want += [useful[place - 1][1]] if place else [table.byte_ids[b] for b in char.encode()] if table.byte_ids else [table.unknown]
        assert got[r.unit] == want, r.unit


def test_short_units_need_no_fold_in_the_plan(spark):
    model = pieces.load_pieces()
    plan = lambda units: pieces.segment(_frame(spark, units), model)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan(["▁a", "▁house"])
    assert "aggregate(" in plan(["▁a", "b" * 65])
    assert pieces.segment(_frame(spark, []), model).count() == 0
