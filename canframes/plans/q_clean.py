"""Queries: cleaning of the dirty text table."""

from __future__ import annotations

from canframes.functions.clean import drop_incomplete, read_and_clean
from canframes.plans.catalog import register
from canframes.plans.fixtures import frames_raw, number_sql, oracle
from canframes.schema import FEATURES

_CLEAN = (
    "SELECT * FROM (SELECT frame_id, ID, "
    + ", ".join(f"{number_sql(c)} AS {c}" for c in FEATURES)
    + ", CASE lower(label) WHEN 'benign' THEN 0 WHEN '0' THEN 0 WHEN 'attack' THEN 1 WHEN '1' THEN 1 END AS label"
    " FROM frames_raw) t WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in ["frame_id", "ID", *FEATURES, "label"])
)


@register("clean_frames", oracle(_CLEAN, ["frames_raw"]))
def q_clean_frames(spark, sf_dir):
    return drop_incomplete(read_and_clean(frames_raw(spark, sf_dir)))
