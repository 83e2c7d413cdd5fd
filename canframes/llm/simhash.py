"""SimHash near-duplicates: 64-bit fingerprints linked at a small bit distance.

Links are found with an inverted index over positional bytes and a count filter. A posting
is keyed by a block of four of the eight byte positions and the bytes there (single bytes
as keys would make postings that grow with the square of the corpus). The 14 blocks are the
sets of four positions whose numbers have XOR 0; any three positions stand together in
exactly one of them, so the number of blocks that two fingerprints share tells how many
positional bytes they share: 14 of 14 blocks for 8 bytes, 7 for 7, 3 for 6, at most 1 for
fewer. Fingerprints within ``max_bits`` = 2 bits share at least 6 bytes and so at least 3
postings: the shared postings of each pair are tallied, pairs below that guaranteed minimum
go, the rest is verified by its bit distance.

Postings longer than ``max_posting`` fingerprints (groups of near copies) are not paired:
their fingerprints go to *midpoints* instead, themselves and their 64 one-bit neighbours.
Two fingerprints share a midpoint exactly if they differ in at most 2 bits, and a midpoint
has at most 65 fingerprints, so these groups stay linear. No link is lost: a pair within
the distance either meets in short postings alone, and then its tally is whole, or meets in
a long one, and then both are at midpoints."""

from __future__ import annotations

import itertools

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canframes.llm.common import map_batches, text_key
from canframes.llm.components import connected_components
from canframes.session import land

SEED = 42
BLOCKS = [b for b in itertools.combinations(range(8), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0]
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """Signed 64-bit SimHash of the word shingles (repeats included) of a text lower-cased
    in A-Z; fewer words than a shingle: the whole sequence; no word: 0."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only ASCII case and white space
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), _CHUNK):
        bits = np.unpackbits(h[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, text_key, fp) for every row."""

    def run(rows):
        for r in rows:
            yield {"doc_id": r["doc_id"], "text_key": r["text_key"], "fp": fingerprint(r["text"], shingle_words)}

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))
    return map_batches(src, "doc_id long, text_key string, fp long", run, ["doc_id", "text", "text_key"])


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def least_shared(max_bits: int) -> int:
    """Blocks that two fingerprints share at least when ``max_bits`` bytes differ."""
    return sum(not set(range(max_bits)) & set(block) for block in BLOCKS)


def links(nodes: DataFrame, max_bits: int = 2, max_posting: int = 64) -> DataFrame:
    """(a, b) links a < b that connect exactly the distinct fingerprints ``fp`` within
    ``max_bits`` (1 or 2) of each other: all such pairs of ordinary postings, and for long
    postings enough of them to keep the same groups."""
    if max_bits not in (1, 2):
        raise ValueError("the index is laid out for a bit distance of 1 or 2")
    fp = F.col("fp")
    keys = []
    for place, block in enumerate(BLOCKS):
        key = F.lit(0).cast("long")
        for i in block:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, i))
        keys.append(F.struct(F.lit(place).alias("place"), key.alias("key")))
    postings = nodes.select("fp", F.explode(F.array(*keys)).alias("p")).select("fp", "p.place", "p.key")
    # landed, so that a key that many fingerprints share can be split
    sizes = land(postings.groupBy("place", "key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-sizes")
    shared = land(postings.join(sizes, ["place", "key"]), "simhash-postings")
    short, long = shared.filter(F.col("n") <= max_posting), shared.filter(F.col("n") > max_posting)
    left = short.select("place", "key", F.col("fp").alias("a"))
    right = short.select("place", "key", F.col("fp").alias("b"))
    tally = left.join(right, ["place", "key"]).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("blocks"))
    paired = (
        tally.filter(F.col("blocks") >= least_shared(max_bits))
        .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
        .select("a", "b")
    )
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63))) for b in range(64)])
    near = long.select("fp").distinct().select("fp", F.explode(flips).alias("mid"))
    if max_bits == 1:  # a one-bit link joins a fingerprint and a midpoint that is one itself
        hub = near.filter("mid <> fp").join(nodes.select(F.col("fp").alias("mid")), "mid").select(F.least("fp", "mid").alias("a"), F.greatest("fp", "mid").alias("b"))
    else:
        hub = (
            near.groupBy("mid").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
            .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b")
        )
    return paired.unionByName(hub).distinct()


def simhash_groups(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2, max_posting: int = 64) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest
    doc_id reachable over links, itself included), text_key, component_fp.

    Defined cases: a null or empty text has fingerprint 0 and links like any other; rows with
    a null doc_id take part, but the smallest id ignores them (null if a group has no other);
    repeated rows give repeated results; an empty table gives no rows; other columns of
    ``docs`` are not looked at."""
    fps = land(fingerprints(docs, shingle_words), "simhash-fp")
    nodes = land(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp"), max_bits, max_posting), "simhash-components")
    named = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("component_fp"))
    least = named.groupBy("component_fp").agg(F.min("rep").alias("component_id"))
    groups = named.join(least, "component_fp").select("fp", "component_fp", "component_id")
    return fps.join(groups, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "text_key", "component_fp"
    )


def keep_one_of_each_group(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` with one document of each group left: the one with the smallest
    doc_id (of repeated ids the smallest text digest; one of fully repeated rows)."""
    groups = simhash_groups(docs, **params)
    first = groups.groupBy("component_fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_key")).alias("k"))
    keep = first.select(F.col("k.doc_id").alias("_id"), F.col("k.text_key").alias("_key"))
    keyed = docs.withColumn("_id", F.col("doc_id").cast("long")).withColumn("_key", text_key(F.col("text")))
    on = [keyed["_id"].eqNullSafe(keep["_id"]), keyed["_key"] == keep["_key"]]
    return keyed.join(keep, on, "left_semi").dropDuplicates(["_id", "_key"]).drop("_id", "_key")
