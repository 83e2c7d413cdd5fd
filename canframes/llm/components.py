"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations and two joins over the edges, landed in the shared folder;
edges are never collected. A node with very many neighbours is pre-aggregated (its minimum
is a partial aggregate, landed) and only meets the join as a skewed key of a plain shuffle,
which adaptive execution splits. The round count grows with the logarithm of the component sizes; the loop ends when
a round changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canframes.session import land


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = land(least, "star-minima")
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = land(down.groupBy("a").agg(F.min("b").alias("m")), "star-minima")
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` (a, b): undirected links between comparable node ids. Returns (node, root),
    root the smallest node of the component, for every node with a link to another node.
    Null ends and self-links are ignored; repeated links count once; no edges, no rows."""
    e = edges.select("a", "b").filter("a <> b").distinct()
    e = land(e, name)
    last = _state(e)
    while last[0]:
        e = land(_small_star(_large_star(e)), name)
        now = _state(e)
        if now == last:
            break
        last = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
