"""N-gram Jaccard join by T-occurrence search in the manner of DivideSkip.

A document is the set of 64-bit hashes of its distinct word shingles, sorted; equal sets are one
*node*. An inverted list holds the nodes of one shingle. A set of size n can only link with one
that shares T = ceil(t * n) shingles or more (t the least similarity), so a partner stands on T of
its n lists. DivideSkip merges the short lists only and probes the others for the few ids that
the merge leaves: an id that stands on T lists stands on T - L of the short ones, L being the
number of lists that were not merged.

*Which lists are merged.* All sets are cut by one order, that of the hashes. The first
q = 1.5 p + 4 shingles (p = n - T + 1) are the *head* of a node. Two linked sets share the
first common shingles in both heads: c(n) = T - n + q of them, or those of the smaller set. Only
heads are indexed. Of these, lists of up to ``max_list`` nodes are the short ones; longer lists (a
passage that many documents share) are never sent anywhere.

*Merge.* Each node gets its short lists (no longer than ``max_list``, no more than its head), merges
them with a heap that skips (``merge_short``), and keeps ids found c - f times or more, f the
number of its head's long lists. *Probe.* Kept pairs look the rest of one head up in the other by
binary search and need c in all. *Check.* What is left compares whole sets: 100 * shared >= percent
* united, exactly. A pair is lost only if equal hashes stand for different shingles.

*Crowded nodes*, with f >= c, may share nothing on short lists (members of large groups of near copies).
Two of them that link share c long lists, so each needs only its f - c + 1 shortest long
ones. Lists with the same smallest node (by hash) form a group around it, the hub. Members are checked
with the hub; those that link are settled, and all others search the whole group, in blocks of
bounded size (``block_links``), where lists are short again or probed. Work on a group is its size
times the number of members that do not link with its hub; no task holds more than two blocks,
and a block gives back a spanning forest of its links.

Links lead to connected components; a document gets the smallest doc_id of its component."""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canframes.llm.common import bounded_batches
from canframes.llm.components import connected_components
from canframes.operators.positions import join_small
from canframes.session import land

SHINGLE_WORDS = 4
PERCENT = 85
MAX_LIST = 64
#: shingles that a block of a crowded group holds, about (one set may be larger)
BLOCK_SHINGLES = 1 << 19
#: weight of a probe against a merge step, in the rule that divides lists into short and long
PROBE_WEIGHT = 0.5
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def shingle_set(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text lower-cased in A-Z; with fewer words the
    whole sequence is one shingle; without words none."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only ASCII case and white space
    if not words:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(shingle_words, len(words))
    m = len(h) - k + 1
    z = np.full(m, k, dtype=np.uint64)
    for i in range(k):
        z = ((z ^ (z >> np.uint64(31))) * _ODD[0] + h[i : i + m]) * _ODD[1]
    z = (z ^ (z >> np.uint64(29))) * _ODD[2]
    return np.unique((z ^ (z >> np.uint64(32))).view(np.int64))


# --- sizes, as numbers and as columns ------------------------------------------------------------


def needed(n, percent: int):
    """T: the least overlap of a set of ``n`` with any set it links with, and the least size of one."""
    return (n * percent + 99) // 100


def head_size(n, percent: int):
    p = n - needed(n, percent) + 1
    return np.minimum(n, p + p // 2 + 4)


def head_overlap(n, percent: int):
    """c: shingles that the heads of two linked sets share if the smaller one has ``n``."""
    return needed(n, percent) - n + head_size(n, percent)


def _needed(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100).cast("long")


def _overlap_with_any(n: Column, percent: int) -> Column:
    """c of the smallest set that one of ``n`` can link with."""
    m = _needed(n, percent)
    p = m - _needed(m, percent) + 1
    return F.least(_needed(m, percent), F.floor(p / 2).cast("long") + 5)


def _alike_in_size(a: Column, b: Column, percent: int) -> Column:
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


# --- T-occurrence search ---------------------------------------------------------------------------


def merge_short(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """(id, number of lists) of the ids on ``least`` or more of the sorted lists. A heap holds the
    next id of each list; where too few lists agree, ``least - 1`` of them jump to the next id that
    can still be reached."""
    heap = [(x[0], k, 0) for k, x in enumerate(lists) if x]
    heapq.heapify(heap)
    found = []
    while len(heap) >= least:
        low, taken = heap[0][0], []
        while heap and heap[0][0] == low:
            taken.append(heapq.heappop(heap))
        if len(taken) >= least:
            found.append((low, len(taken)))
            goal = low + 1
        else:
            while heap and len(taken) < least - 1:
                taken.append(heapq.heappop(heap))
            if not heap:
                break
            goal = heap[0][0]
        for _, k, at in taken:
            at = bisect_left(lists[k], goal, at)
            if at < len(lists[k]):
                heapq.heappush(heap, (lists[k][at], k, at))
    return found


def probe(ids: np.ndarray, sorted_list: np.ndarray) -> np.ndarray:
    """For each id whether the sorted list holds it, by binary search."""
    if not len(sorted_list):
        return np.zeros(len(ids), dtype=bool)
    at = np.searchsorted(sorted_list, ids)
    at[at == len(sorted_list)] = 0
    return sorted_list[at] == ids


def divide_skip(lists: list[np.ndarray], need: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids below ``size`` on ``need`` or more of the sorted lists, with their counts: the longest L
    lists are probed for what the others, counted together, leave with ``need - L``."""
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < need:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    apart = min(need - 1, int(need / (PROBE_WEIGHT * math.log2(len(lists[-1]) + 1) + 1)))
    merged = lists[: len(lists) - apart]
    count = np.bincount(np.concatenate(merged), minlength=size) if merged else np.zeros(size, dtype=np.int64)
    ids = np.flatnonzero(count >= need - apart)
    count = count[ids]
    for left, x in zip(range(apart - 1, -1, -1), lists[len(lists) - apart :], strict=True):
        count = count + probe(ids, x)
        stay = count >= need - left
        ids, count = ids[stay], count[stay]
    return ids, count


def block_links(queries: list[tuple[int, np.ndarray]], indexed: list[tuple[int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``queries`` and ``indexed`` (node, set): each query is
    a T-occurrence search on the inverted lists of the indexed sets."""
    if not queries or not indexed:
        return []
    sizes = np.array([len(z) for _, z in indexed])
    shingles = np.concatenate([z for _, z in indexed])
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], np.repeat(np.arange(len(indexed)), sizes)[order]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for node, z in queries:
        start, stop = np.searchsorted(shingles, z, side="left"), np.searchsorted(shingles, z, side="right")
        ids, shared = divide_skip([owner[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True) if b > a], needed(len(z), percent), len(indexed))
        linked = 100 * shared >= percent * (len(z) + sizes[ids] - shared)
        for i in ids[linked].tolist():
            a, b = find(node), find(indexed[i][0])
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((node, indexed[i][0]))
    return links


# --- Spark --------------------------------------------------------------------------------------


def _arrays(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *values])))


def _heads(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """One row per row: doc_id, text_key, set_key (digest of the set), n, head."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                sets = [shingle_set(t, shingle_words) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([hashlib.md5((t or "").encode("utf-8")).digest() for t in texts], pa.binary()),
                        pa.array([hashlib.md5(z.tobytes()).digest() for z in sets], pa.binary()),
                        pa.array([len(z) for z in sets], pa.int64()),
                        _arrays([z[: int(head_size(len(z), percent))] for z in sets]),
                    ],
                    names=["doc_id", "text_key", "set_key", "n", "head"],
                )

    return docs.mapInArrow(run, "doc_id long, text_key binary, set_key binary, n long, head array<long>")


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle_words: int) -> DataFrame:
    """(node, z): the whole sets of the wanted nodes (node, rep_id, text_key), from one row each."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("node"), _arrays([shingle_set(t, shingle_words) for t in part.column("text").to_pylist()])], names=["node", "z"])

    keyed = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("rep_id"), "text", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("text_key"))
    rows = join_small(keyed, wanted, ["rep_id", "text_key"], "inner", wanted.count(), 64)
    return rows.dropDuplicates(["node"]).select("node", "text").mapInArrow(run, "node long, z array<long>")


def _merged(entries: DataFrame, percent: int, max_list: int) -> DataFrame:
    """(a, b): for each node the ids that its short lists leave."""
    short = entries.filter(F.col("df") <= max_list).groupBy("s").agg(F.sort_array(F.collect_list(F.struct("node", "n"))).alias("m"))
    each = short.select(F.posexplode("m").alias("at", "x"), "m")
    earlier = F.expr(
        f"transform(filter(slice(m, 1, at), y -> least(y.n, x.n) * 100 >= greatest(y.n, x.n) * {percent}), y -> y.node)"
    )
    own = each.select(F.col("x.node").alias("node"), F.col("x.n").alias("n"), earlier.alias("ids"), F.lit(0).alias("f")).filter(F.size("ids") > 0)
    long = entries.filter(F.col("df") > max_list).groupBy("node", "n").agg(F.count("*").cast("int").alias("f"))
    long = long.select("node", "n", F.lit(None).cast("array<long>").alias("ids"), "f")
    lists = own.unionByName(long).groupBy("node", "n").agg(F.collect_list("ids").alias("lists"), F.sum("f").alias("f")).filter(F.size("lists") > 0)
    least = F.greatest(F.lit(1), _overlap_with_any(F.col("n"), percent) - F.col("f"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                a, b = [], []
                for node, lists, least in zip(*(part.column(c).to_pylist() for c in ("node", "lists", "least")), strict=True):
                    ids = [i for i, _ in merge_short(lists, least)]
                    a += [node] * len(ids)
                    b += ids
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return lists.select("node", "lists", least.alias("least")).mapInArrow(run, "a long, b long")


def _probed(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole heads share enough."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("head").alias("ha"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("head").alias("hb"))

    def run(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                ha, hb = (batch.column(c)[i].values.to_numpy() for c in ("ha", "hb"))
                least = head_overlap(min(batch.column("na")[i].as_py(), batch.column("nb")[i].as_py()), percent)
                keep.append(bool(probe(ha, hb).sum() >= least))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ha", "hb").mapInArrow(run, "a long, b long")


def _groups(entries: DataFrame, percent: int, max_list: int) -> DataFrame:
    """(hub, node, n): the groups of crowded nodes."""
    long = entries.filter(F.col("df") > max_list)
    own = Window.partitionBy("node")  # as many rows as the head of the node has
    long = long.withColumn("f", F.count("*").over(own)).withColumn("at", F.row_number().over(own.orderBy("df", "s")))
    c = _overlap_with_any(F.col("n"), percent)
    used = land(long.filter((F.col("f") >= c) & (F.col("at") <= F.col("f") - c + 1)).select("s", "node", "n"), "ngram-crowded")
    first = F.min(F.struct(F.xxhash64("node").alias("h"), "node"))
    hubs = land(used.groupBy("s").agg(first.alias("first"), F.count("*").alias("m")).filter("m > 1").select("s", F.col("first.node").alias("hub")), "ngram-hubs")
    return land(used.join(hubs, "s").select("hub", "node", "n").distinct(), "ngram-groups")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    shared = F.size(F.array_intersect("za", "zb"))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("z").alias("za")), "a").join(sets.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b")
    return both.filter(100 * shared >= percent * (F.size("za") + F.size("zb") - shared)).select("a", "b")


def _searched(groups: DataFrame, stars: DataFrame, sets: DataFrame, percent: int, block_shingles: int) -> DataFrame:
    """(a, b): links between the members of a group that its hub does not settle and all members."""
    settled = stars.select(F.col("a").alias("hub"), F.col("b").alias("node"))
    asking = land(groups.filter("hub <> node").join(settled, ["hub", "node"], "left_anti"), "ngram-asking")
    shares = lambda t, name: t.groupBy("hub").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias(name))
    blocks = land(shares(asking, "nq").join(shares(groups, "ni"), "hub"), "ngram-blocks")
    block = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    ask = asking.join(blocks, "hub").select("hub", "node", F.lit(True).alias("asks"), block("nq").alias("q"), every("ni").alias("i"))
    tell = groups.join(blocks, "hub").select("hub", "node", F.lit(False).alias("asks"), every("nq").alias("q"), block("ni").alias("i"))
    rows = ask.unionByName(tell).join(sets, "node")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = {asks: list(zip(part["node"].tolist(), part["z"], strict=True)) for asks, part in pdf.groupby("asks")}
        return pd.DataFrame(block_links(side.get(True, []), side.get(False, []), percent), columns=["a", "b"], dtype="int64")

    return rows.groupBy("hub", "q", "i").applyInPandas(run, "a long, b long").filter("a <> b")


def similar_documents(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, max_list: int = MAX_LIST, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable over links of ``percent`` per
    cent Jaccard similarity or more, itself included) for every row.

    Defined cases: a null text or one without words has 0 shingles and is alone; equal sets link;
    rows with a null doc_id take part, but the smallest id ignores them (null if a component has no
    other); repeated rows give repeated results; an empty table gives no rows; other columns of
    ``docs`` are not looked at."""
    if not 1 <= percent <= 100:
        raise ValueError("percent is 1 to 100")
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = land(_heads(src, shingle_words, percent), "ngram-rows")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(-1)).alias("rep_id"), "text_key"))
    of_set = rows.filter("n > 0").groupBy("set_key").agg(first.alias("rep"), F.min("doc_id").alias("least_id"), F.first("n").alias("n"), F.first("head").alias("head"))
    nodes = land(of_set.select(F.monotonically_increasing_id().alias("node"), "set_key", "rep.rep_id", "rep.text_key", "least_id", "n", "head"), "ngram-nodes")

    can_link = (100 - percent) * F.col("n") >= percent  # else no other set is similar enough
    postings = nodes.filter(can_link).select("node", "n", F.explode("head").alias("s"))
    shared = land(postings.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1"), "ngram-lists")
    entries = land(postings.join(shared, "s").select("s", "df", "node", "n"), "ngram-entries")
    pairs = land(_probed(_merged(entries, percent, max_list), nodes, percent), "ngram-pairs")
    groups = _groups(entries, percent, max_list)

    members = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(groups.select("node")).distinct()
    wanted = land(nodes.select("node", "rep_id", "text_key").join(members, "node", "left_semi"), "ngram-wanted")
    sets = land(_sets_of(src, wanted, shingle_words), "ngram-sets")
    sized = groups.join(groups.filter("hub = node").select("hub", F.col("n").alias("nh")), "hub").filter(_alike_in_size(F.col("n"), F.col("nh"), percent))
    stars = land(_verified(sized.filter("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), sets, percent), "ngram-stars")
    links = _verified(pairs, sets, percent).unionByName(stars).unionByName(_searched(groups, stars, sets, percent, block_shingles))

    roots = connected_components(links, "ngram-components")
    named = nodes.select("set_key", "node", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = land(named.select("set_key", "root", "least_id"), "ngram-named")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = land(named.join(least, "root").select("set_key", "component_id"), "ngram-classes")
    with_words = rows.filter("n > 0").select("doc_id", "n", "set_key").join(classes, "set_key").select("doc_id", "n", "component_id")
    without = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return with_words.unionByName(without).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
