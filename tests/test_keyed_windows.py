"""Count windows in keyed state: against the batch rule, over restarts, with bounded state."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from canframes.session import work_path
from canframes.streaming.keyed_windows import keyed_windows, read_keyed_windows, start_keyed_windows, take_frames

SCHEMA = "ID long, t long, frame_id long, label int"


def write(spark, path, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz")).drop("t")
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def run(spark, src, schema, path, ck, **params):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    start_keyed_windows(keyed_windows(stream, **params), path, ck, availableNow=True).awaitTermination()
    return sorted(tuple(r) for r in read_keyed_windows(spark, path).collect() if not r.late)


def batch_windows(rows, timesteps, step, rule, ratio):
    out = []
    for i in {r[0] for r in rows}:
        own = sorted((r[1], r[2], r[3]) for r in rows if r[0] == i)
        for s in range(0, len(own) - timesteps + 1, step):
            y = [r[2] for r in own[s : s + timesteps]]
            v = y[-1] if rule == "last" else int(any(y)) if rule == "any" else int(sum(y) / timesteps >= ratio)
            out.append((str(i), s, own[s][1], v, False))
    return sorted(out)


@pytest.mark.parametrize("timesteps,step,rule", [(4, 1, "any"), (5, 3, "ratio"), (1, 1, "last"), (6, 2, "last")])
def test_batches_of_one_id_equal_the_whole(timesteps, step, rule):
    rng = random.Random(timesteps)
    for _ in range(50):
        n = rng.randint(0, 40)
        rows = [(1, t // 2, t, rng.randrange(2)) for t in range(n)]  # ties in time
        cuts = sorted(rng.sample(range(n + 1), min(3, n)))
        tail, got = (0, [], [], []), []
        for a, b in zip([0, *cuts], [*cuts, n], strict=True):
            part = rows[a:b]
            rng.shuffle(part)
            cols = [np.array([r[k] for r in part], dtype=np.int64) for k in (1, 2, 3)]
            tail, (s, f, y), late = take_frames(tail, *cols, timesteps, step, rule, 0.5)
            assert not late.any() and len(tail[1]) <= max(timesteps - 1, 1)
            got += [("1", int(x), int(i), int(v), False) for x, i, v in zip(s, f, y, strict=True)]
        assert sorted(got) == batch_windows(rows, timesteps, step, rule, 0.5)


def test_restart_goes_on_from_the_checkpoint_and_state_is_bounded(spark):
    rng = random.Random(2)
    rows = [(i, t, 100 * i + t, rng.randrange(2)) for i in range(4) for t in range(30)]
    src, path, ck = work_path(spark, "keyed-in"), work_path(spark, "keyed-out"), work_path(spark, "keyed-ck")
    for lo, hi in ((0, 7), (7, 8)):
        schema = write(spark, src, [r for r in rows if lo <= r[1] < hi])
    first = run(spark, src, schema, path, ck, timesteps=5)
    assert first == batch_windows([r for r in rows if r[1] < 8], 5, 1, "any", 0)
    write(spark, src, [r for r in rows if 8 <= r[1] < 30])  # the query starts anew on the same checkpoint
    assert run(spark, src, schema, path, ck, timesteps=5) == batch_windows(rows, 5, 1, "any", 0)
    state = spark.read.format("statestore").load(ck).select("value.*").collect()
    held = [r.asDict(recursive=True) for r in state]
    lists = [v for r in held for v in _arrays(r)]
    assert len(state) == 4 and lists and max(map(len, lists)) == 4


def _arrays(value):
    if isinstance(value, dict):
        return [x for v in value.values() for x in _arrays(v)]
    return [value] if isinstance(value, list) else []


def test_late_and_timeless_frames_go_to_the_side(spark):
    src, path, ck = work_path(spark, "keyed-in"), work_path(spark, "keyed-out"), work_path(spark, "keyed-ck")
    schema = write(spark, src, [(1, t, t, 0) for t in range(6)] + [(None, 1, 99, 1)])
    write(spark, src, [(1, 3, 50, 1), (1, None, 51, 1), (1, 6, 6, 1), (1, 5, 5, 0)])
    got = run(spark, src, schema, path, ck, timesteps=3)
    assert got == [("1", s, s, int(s == 4), False) for s in range(5)]
    late = sorted((r.start, r.start_frame_id, r.y) for r in read_keyed_windows(spark, path).filter("late").collect())
    assert late == [(None, 5, 0), (None, 50, 1), (None, 51, 1)]


def test_idle_ids_leave_the_state(spark):
    src, path, ck = work_path(spark, "keyed-in"), work_path(spark, "keyed-out"), work_path(spark, "keyed-ck")
    hour = 3600
    schema = write(spark, src, [(1, 60 + t, t, 0) for t in range(3)] + [(2, 60, 200, 0)])
    write(spark, src, [(2, 10 * hour, 201, 0)])
    write(spark, src, [(2, 20 * hour, 202, 0)])
    write(spark, src, [(2, 21 * hour, 203, 0), (1, 21 * hour, 4, 1)])
    run(spark, src, schema, path, ck, timesteps=2, idle_ms=hour * 1000, delay="1 minute")
    one = [r.start for r in read_keyed_windows(spark, path).filter("ID = '1' AND NOT late").collect()]
    assert sorted(one) == [0, 1]  # the frame after the pause starts a new numbering, no window of two yet
