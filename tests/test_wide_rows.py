"""Tables with rows of many kilobytes are landed in small row groups, so that a task never decodes
thousands of them at once, however well they compress."""

from __future__ import annotations

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from canframes.operators import sigmoid_net
from canframes.operators.seq_models import GROUP_CHUNKS, _chunk_reader, sequence_chunks
from canframes.session import land


def _groups(df):
    """Rows of the row groups of every landed file."""
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in df.inputFiles()]
    return [[m.row_group(i).num_rows for i in range(m.num_row_groups)] for m in files]


def test_land_limits_the_rows_of_a_group(spark):
    got = _groups(land(spark.range(250).coalesce(1), "wide", group_rows=100))
    assert got == [[100, 100, 50]]
    assert _groups(land(spark.range(250).coalesce(1), "narrow")) == [[250]]


@pytest.fixture(scope="module")
def chunks(spark):
    fp = spark.range(12 * 450).select(
        F.col("id").alias("frame_id"), (F.col("id") % 450).alias("ID"), F.floor(F.col("id") / 450).alias("pos"), F.lit(12).cast("long").alias("n_in_id"),
        (F.col("id") % 7).cast("double").alias("x1"), (F.col("id") % 5 == 0).cast("int").alias("label"),
    )
    return sequence_chunks(fp, ["x1"], timesteps=4)


def test_chunks_are_landed_in_small_groups(chunks):
    got = _groups(chunks)
    assert sum(map(sum, got)) == 450 == chunks.count()
    assert max(map(max, got)) <= GROUP_CHUNKS < max(map(sum, got))  # some file holds more than one group


def test_blocks_are_landed_in_small_groups(chunks):
    blocks = sigmoid_net.packed(chunks.select("frames", "windows").coalesce(1), _chunk_reader(1, False))
    got = _groups(blocks)
    assert sum(map(sum, got)) == 450 == blocks.count()
    assert max(map(max, got)) <= sigmoid_net.GROUP_BLOCKS
