"""Matches of a pattern with code-point offsets, in SQL functions alone.

``split`` gives the texts between the matches and ``regexp_extract_all`` the matches
themselves, so a match starts at the summed lengths before it. Patterns must match at least
one character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 256


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def running_totals(lengths: Column) -> Column:
    """For each element the sum of those before it. Two levels (blocks of 256), since
    appending to one long array copies it at each step."""
    ints = F.array().cast("array<int>")

    def block_totals(block: Column, start: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(start.alias("t"), ints.alias("o")),
            lambda acc, x: F.struct((acc["t"] + x).alias("t"), F.concat(acc["o"], F.array(acc["t"])).alias("o")),
        )

    last = F.greatest(F.size(lengths) - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(last / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    parts = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("t"), F.array().cast("array<array<int>>").alias("p")),
        lambda acc, blk: let(
            block_totals(blk, acc["t"]),
            lambda r: F.struct(r["t"].alias("t"), F.concat(acc["p"], F.array(r["o"])).alias("p")),
        ),
    )
    return F.flatten(parts["p"])


def matches(text: Column, pattern: str, only_if: Column) -> Column:
    """array<struct<start, end, surface, before, after>> of the leftmost non-overlapping
    matches; ``before`` and ``after`` are the unmatched texts around. Empty where ``only_if``
    is not true (a cheap test that no match can pass)."""
    empty = F.array().cast("array<struct<start:int,end:int,surface:string,before:string,after:string>>")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def build(h: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        return let(gaps, lambda g: let(
            running_totals(F.zip_with(h, F.slice(g, F.lit(1), F.size(h)), lambda a, b: F.length(a) + F.length(b))),
            lambda at: F.transform(
                F.sequence(F.lit(0), F.size(h) - 1),
                lambda i: let(F.get(at, i) + F.length(F.get(g, i)), lambda s: F.struct(
                    s.alias("start"), (s + F.length(F.get(h, i))).alias("end"), F.get(h, i).alias("surface"),
                    F.get(g, i).alias("before"), F.get(g, i + 1).alias("after"),
                )),
            ),
        ))

    return F.when(only_if, let(hits, lambda h: F.when(F.size(h) > 0, build(h)).otherwise(empty))).otherwise(empty)
