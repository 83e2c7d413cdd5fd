"""Benchmark decontamination: containment search for short test items in long documents.

Shingles are five words (letters and digits of the lower-cased text; a shorter sequence is
one shingle as a whole). An item counts as found in a document that holds at least
``containment`` = 0.8 of its distinct shingles.

Candidates come from bottom-k MinHash sketches of the *items* alone, partitioned by item
size: class c holds the items of 2^c to 2^(c+1) - 1 distinct shingles and asks for
m = max(1, c) matches. An item of n shingles misses at most n - ceil(0.8 n) of them in a
document that contains it, so of its k = n - ceil(0.8 n) + m sketch shingles such a document
holds at least m, whatever the document's length (a sketch of the whole document would be
dominated by its other text). The matches of each document and item are tallied and pairs under
the m of the class go: no pair is lost. The order of the sketch is by hash inside bands of sharing (powers
of two of the items that have the shingle): by hash alone a phrase of a third of the items
stands in all their sketches and brings each document with that phrase together with each
of them.

The sketch is a part of the benchmark's shingles. It is broadcast if its counted size is
under the library's broadcast bound (64 MB), else joined by shuffle; document shingles are hashed in a narrow
pass. Candidate pairs are then verified by exact shingle containment on strings. SQL
functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canframes.llm.common import text_key
from canframes.llm.spans import let
from canframes.operators.positions import join_small
from canframes.session import land

SHINGLE_WORDS, CONTAINMENT = 5, 0.8


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(text: Column, k: int = SHINGLE_WORDS) -> Column:
    """Word shingles of a text; a text of fewer words is one shingle, of none no shingle."""

    def build(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " "))
        whole = F.array(F.array_join(w, " "))
        return F.when(F.size(w) >= k, many).when(F.size(w) > 0, whole).otherwise(F.array().cast("array<string>"))

    return let(words(text), build)


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """(item, shingles, n, ids): every distinct shingle list of an item that has a word, with
    the ids of the items that have it; ``item`` is its digest."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.array_distinct(shingles(F.col("text"))).alias("shingles"))
    b = b.filter("size(shingles) > 0").withColumn("item", F.md5(F.array_join("shingles", "\n").cast("binary")))
    return b.groupBy("item").agg(F.first("shingles").alias("shingles"), F.collect_set("item_id").alias("ids")).withColumn("n", F.size("shingles"))


def needed(n: Column, containment: float = CONTAINMENT) -> Column:
    """Shingles that must be found: the smallest whole number not under containment * n."""
    return F.ceil(F.round(n * F.lit(containment), 6)).cast("int")


def matches(size_class: Column, need: Column) -> Column:
    """Sketch shingles that a document which contains an item of this class has at least."""
    return F.least(F.greatest(size_class, F.lit(1)), need)


def sketch(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(h, item, size_class, need): of every item the k lowest shingles in the order (band of
    sharing, hash), with its class and the shingles that a document must have of it."""
    each = items.select("item", "n", F.explode(F.array_distinct(F.transform("shingles", lambda s: F.xxhash64(s)))).alias("h"))
    shared = land(each.groupBy("h").agg(F.floor(F.log2(F.count("*"))).cast("int").alias("band")), "leak-bands")
    lowest = Window.partitionBy("item").orderBy("band", "h")
    classed = each.join(shared, "h").withColumns({"size_class": F.floor(F.log2("n")).cast("int"), "need": needed(F.col("n"), containment)})
    ranked = classed.withColumn("rank", F.row_number().over(lowest))
    low = ranked.filter(F.col("rank") <= F.col("n") - F.col("need") + matches(F.col("size_class"), F.col("need")))
    return low.select("h", "item", "size_class", "need")


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(text_key, ids, found, n) of every distinct text and item with at least the
    needed shingles in common."""
    items = land(item_shingles(benchmark), "leak-items")
    low = land(sketch(items, containment), "leak-sketch")
    # one row a text: equal texts are searched once
    text = docs.select(text_key(F.col("text")).alias("text_key"), "text").filter("text IS NOT NULL")
    hashed = text.select("text_key", F.explode(F.transform(shingles(F.col("text")), lambda s: F.xxhash64(s))).alias("h"))
    met = join_small(hashed, low, "h", "inner", low.count(), 96)
    # at most k hashes a pair
    tally = met.groupBy("text_key", "item", "size_class", "need").agg(F.size(F.collect_set("h")).alias("hits"))
    pairs = land(tally.filter(F.col("hits") >= matches(F.col("size_class"), F.col("need"))).select("text_key", "item"), "leak-pairs")
    keys = pairs.select("text_key").distinct()
    n_keys = keys.count()
    bodies = join_small(text, keys, "text_key", "left_semi", n_keys, 64).dropDuplicates(["text_key"])
    bodies = bodies.select("text_key", F.array_distinct(shingles(F.col("text"))).alias("body"))
    checked = pairs.join(items, "item").join(bodies, "text_key").select(
        "text_key", "ids", "n", F.size(F.array_intersect("shingles", "body")).alias("found")
    )
    return checked.filter(F.col("found") >= needed(F.col("n"), containment))


def find_leaks(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, n_items, item_ids (ascending,
    comma-joined) and best (largest containment, null without any).

    Defined cases: a null text, or one without a word, is clean; items with a null or
    wordless text match nothing; repeated items each count by their id (null ids are left
    out of the list); repeated rows give repeated results; an empty table on either side is
    no match; other columns are not looked at."""
    each = contaminated(docs, benchmark, containment).select("text_key", F.explode_outer("ids").alias("id"), (F.col("found") / F.col("n")).alias("share"))
    leaks = each.groupBy("text_key").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.max("share").alias("best"))
    leaks = land(leaks.select("text_key", F.array_join("ids", ",").alias("item_ids"), F.size("ids").alias("n_items"), "best"), "leaks")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").isNull().alias("no"))
    out = join_small(rows, leaks, "text_key", "left", leaks.count(), 128)
    hit = F.col("best").isNotNull() & ~F.col("no")
    return out.select(
        "doc_id", hit.alias("contaminated"), F.when(hit, F.col("n_items")).otherwise(F.lit(0)).cast("long").alias("n_items"),
        F.when(hit, F.col("item_ids")).otherwise(F.lit("")).alias("item_ids"), F.when(hit, F.round("best", 6)).alias("best"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` (all their columns) whose text holds no benchmark item."""
    bad = land(contaminated(docs, benchmark, containment).select("text_key").distinct(), "leaks")
    keyed = docs.withColumn("_key", text_key(F.col("text")))
    return join_small(keyed, bad.withColumnRenamed("text_key", "_key"), "_key", "left_anti", bad.count(), 64).drop("_key")


ORACLE = r"""
WITH items AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents
), item_shingles AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM items
), sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id
), doc_shingles AS (
  SELECT rid, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs
), hits AS (
  SELECT rid, item_id, count(DISTINCT s) AS found FROM doc_shingles JOIN item_shingles USING (s) GROUP BY rid, item_id
), leaks AS (
  SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids,
         max(CAST(found AS DOUBLE) / n) AS best
  FROM hits JOIN sizes USING (item_id) WHERE found >= ceil(round(n * 0.8, 6)) GROUP BY rid
)
SELECT doc_id, best IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids, round(best, 6) AS best
FROM docs LEFT JOIN leaks USING (rid)
"""
