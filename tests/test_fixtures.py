"""The derived frame view reproduces the properties documented in FIXTURES.md (sf0.01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from canframes.operators.split import with_group_key
from canframes.plans.fixtures import clean_view, frames
from tests.conftest import SMALL


def test_frames_view_properties(spark):
    f = frames(spark, SMALL)
    r = f.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ID").alias("ids"), F.sum("label").alias("attacks")).first()
    assert (r.n, r.ids, r.attacks) == (10_000, 20, 2_014)
    g = with_group_key(clean_view(spark, SMALL)).groupBy("group_key").agg(F.countDistinct("label").alias("k"))
    s = g.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("k") == 2).alias("mixed")).first()
    assert (s.groups, s.mixed) == (2_596, 422)
    constant = [c for c in ("DATA_6", "DATA_7") if f.select(c).distinct().count() == 1]
    assert constant == ["DATA_6", "DATA_7"]
