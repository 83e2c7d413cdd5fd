"""Row positions inside a key and blocked windows that stay parallel under key skew.

A window function partitioned by ID puts a whole ID into one task; one CAN ID can carry
a third of all frames. Instead:

* ``ranged`` range-partitions rows on (key, order columns), sorts inside the partitions and
  lands the result with its partition number and place, so a hot key is cut over as many
  partitions as its rows need, whatever its type, its size or its ties.
* ``with_positions`` numbers rows inside each key from the landed places and a small
  per-(partition, key) table of counts (at most partitions + keys rows).
* ``blocked`` cuts each key into blocks of ``block_rows`` positions and copies the few
  boundary rows a window frame needs (look-back / look-ahead) into the neighbour block,
  so window functions can be partitioned by (key, block) with bounded task size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canframes.schema import N_COL, POS_COL
from canframes.session import land

DEFAULT_BLOCK_ROWS = 1 << 20
_BLK, _OWN = "_blk", "_own"


BROADCAST_LIMIT_BYTES = 64 << 20


def join_small(big: DataFrame, small: DataFrame, on, how: str, n_rows: int, row_bytes: int) -> DataFrame:
    """Broadcast ``small`` only when its size (known row count x row width) is under the
    limit; beyond it a regular join, which AQE can still split when a key is skewed."""
    if n_rows * row_bytes <= BROADCAST_LIMIT_BYTES:
        small = F.broadcast(small)
    return big.join(small, on, how)


def ranged(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """``df`` sorted by ``order`` over range partitions, landed with ``_pid`` (partition
    number, ascending in the order) and ``_mid`` (consecutive inside a partition). ``order``
    should end in columns that make rows unique, so that no run of ties is too large for a
    partition."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return land(dealt.withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()}), "ranged")


def join_same(left: DataFrame, small: DataFrame, on: list[str], n_rows: int, row_bytes: int) -> DataFrame:
    """:func:`join_small`, inner, with null keys equal to each other."""
    right = small.select(*[F.col(f"`{c}`").alias(f"_same_{i}") if c in on else F.col(f"`{c}`") for i, c in enumerate(small.columns)])
    pairs = [left[f"`{c}`"].eqNullSafe(right[f"_same_{i}"]) for i, c in enumerate(small.columns) if c in on]
    joined = join_small(left, right, reduce(lambda a, b: a & b, pairs), "inner", n_rows, row_bytes)
    return joined.drop(*[f"_same_{i}" for i, c in enumerate(small.columns) if c in on])


def with_positions(
    df: DataFrame, key: str, order: list[str], pos: str = POS_COL, n: str = N_COL, parts: int | None = None
) -> DataFrame:
    """Add the 0-based position of each row inside ``key`` (sorted by ``order``, nulls last,
    which must make rows unique) and the number of rows of the key. Null keys are one key."""
    rows = ranged(df, [F.col(f"`{key}`").asc_nulls_last(), *[F.col(f"`{c}`").asc_nulls_last() for c in order if c != key]], parts)
    counts = rows.groupBy(key, "_pid").agg(F.count(F.lit(1)).alias("_c"), F.min("_mid").alias("_m0"))
    earlier = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = land(
        counts.select(key, "_pid", "_m0", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_off"), F.sum("_c").over(Window.partitionBy(key)).alias(n)),
        "offsets",
    )
    out = join_same(rows, offsets, [key, "_pid"], offsets.count(), 96)
    return out.withColumn(pos, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long")).drop("_pid", "_mid", "_m0", "_off")


def blocked(df: DataFrame, pos: str = POS_COL, block_rows: int = DEFAULT_BLOCK_ROWS, lookback: int = 0, lookahead: int = 0) -> DataFrame:
    """Assign each row to block ``pos // block_rows`` (``_own`` = True) and copy the first
    ``lookahead`` rows of a block into the previous block and the last ``lookback`` rows
    into the next block (``_own`` = False). Window frames of at most that reach computed
    per (key, block) then equal the frames over the whole key, for owned rows."""
    if block_rows < max(lookback, lookahead, 1):
        raise ValueError("block_rows must cover the window reach")
    b = F.floor(F.col(pos) / block_rows).cast("long")
    off = F.col(pos) % block_rows
    own = F.struct(b.alias(_BLK), F.lit(True).alias(_OWN))
    ahead = F.struct((b - 1).alias(_BLK), F.lit(False).alias(_OWN))
    back = F.struct((b + 1).alias(_BLK), F.lit(False).alias(_OWN))
    need_ahead = (off < lookahead) & (b > 0) if lookahead > 0 else F.lit(False)
    need_back = off >= block_rows - lookback if lookback > 0 else F.lit(False)
    if lookahead <= 0 and lookback <= 0:
        return df.withColumn(_BLK, b).withColumn(_OWN, F.lit(True))
    # most rows get a one-element array: the generator emits only the rows that exist
    copies = (
        F.when(need_ahead & need_back, F.array(own, ahead, back))
        .when(need_ahead, F.array(own, ahead))
        .when(need_back, F.array(own, back))
        .otherwise(F.array(own))
    )
    exploded = df.withColumn("_cp", F.explode(copies))
    return exploded.select("*", F.col("_cp." + _BLK).alias(_BLK), F.col("_cp." + _OWN).alias(_OWN)).drop("_cp")


def block_window(key: str, pos: str = POS_COL) -> Window:
    return Window.partitionBy(key, _BLK).orderBy(pos)


def owned(df: DataFrame) -> DataFrame:
    return df.filter(F.col(_OWN)).drop(_BLK, _OWN)
