"""Line dedup: common blocks of lines are deleted from the later of two documents.

Lines compare by their words, lower-cased in A-Z. A line alone is a poor key if it is short,
so the keys of a line are the shortest runs of lines from it, forward and backward, that
reach ``min_block_words`` words: a rare line hash by itself, or a few short lines that
together are as rare. Lines without a word inside a run are part of its key. Two documents
share a block worth deleting exactly if they share such a key, and every line with a word of
the block lies in one of the keys shared.

Documents stand in the order of doc_id (nulls last), equal ids by text. Each key is linked
to the *earliest* document that holds it, however many hold it: a document meets at most
one partner per key, all keys of a shared block lead to documents that hold that block's
lines, and boilerplate in a third of all documents stays linear (no cap, nothing
dropped). Each pair is aligned with patience diff on the line hashes (texts do not travel):
the shared runs anchor the alignment along their ascending part with the most words, so that no
short line in another order takes the place of a longer run; between anchors, lines unique on
both sides anchor it along their longest increasing run, the gaps are aligned the same
way, and where no line is unique equal occurrence numbers stand in. Aligned blocks of at
least ``min_block_words`` words go from the later document, and runs that an alignment could
not hold are aligned again until none is left."""

import bisect

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canframes.llm.common import bounded_batches, map_batches
from canframes.session import land

MIN_BLOCK_WORDS = 8


def profile(text: str | None, min_words: int = MIN_BLOCK_WORDS) -> tuple[list[int], list[int], list[int]]:
    """(line hashes, words per line, distinct keys) of a text; ``\\n`` ends a line."""
    lines = [x.lower().split() for x in (text or "").encode("utf-8").split(b"\n")]
    size = [len(x) for x in lines]
    hashes = [_signed(xxhash.xxh64_intdigest(b" ".join(x))) for x in lines]
    keys = {tuple(hashes[a:b]) for a, b in _runs(size, min_words)}
    return hashes, size, sorted({_signed(xxhash.xxh64_intdigest(np.array(r, dtype=np.int64).tobytes(), 1)) for r in keys})


def _runs(size: list[int], min_words: int) -> set[tuple[int, int]]:
    """(start, end) of the shortest runs of lines from each line with a word, forward and
    backward, that reach ``min_words`` words; both ends are lines with a word."""
    n = len(size)
    return _forward(size, min_words) | {(n - b, n - a) for a, b in _forward(size[::-1], min_words)}


def _forward(size: list[int], min_words: int) -> set[tuple[int, int]]:
    out, end, total = set(), 0, 0
    for start in range(len(size)):
        while end < len(size) and total < min_words:
            total += size[end]
            end += 1
        if total < min_words:
            break
        if size[start]:
            out.add((start, end))
        total -= size[start]
    return out


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of ``pairs`` (ascending in the first place) that ascends in the second."""
    tails, at, back = [], [], [0] * len(pairs)
    for i, (_, j) in enumerate(pairs):
        k = bisect.bisect_left(tails, j)
        back[i] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(j)
            at.append(i)
        else:
            tails[k], at[k] = j, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _labelled(lines: list[int], lo: int, hi: int) -> dict:
    """(line, occurrence number) -> position."""
    seen: dict[int, int] = {}
    out = {}
    for i in range(lo, hi):
        n = seen[lines[i]] = seen.get(lines[i], 0) + 1
        out[lines[i], n] = i
    return out


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j), ascending in both, with a[i] == b[j]."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        x, y = _labelled(a, alo, ahi), _labelled(b, blo, bhi)
        once = [(i, y[k]) for k, i in x.items() if k[1] == 1 and k in y and (k[0], 2) not in x and (k[0], 2) not in y]
        anchors = _increasing(sorted(once)) if once else []
        if not anchors:
            out += _increasing(sorted((i, y[k]) for k, i in x.items() if k in y))
            continue
        for i, j in [*anchors, (ahi, bhi)]:
            if alo < i and blo < j:
                todo.append((alo, i, blo, j))
            alo, blo = i + 1, j + 1
        out += anchors
    return sorted(out)


def _heaviest(pairs: list[tuple[int, int]], size: list[int]) -> list[tuple[int, int]]:
    """The part of ``pairs`` (i, j) that ascends in both and has the most words in the lines j (of
    equal ones the most lines), by a prefix-maximum tree over i."""
    pairs = sorted(pairs, key=lambda p: (p[1], -p[0]))
    if all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:])):
        return pairs
    rank = {i: k + 1 for k, i in enumerate(sorted({i for i, _ in pairs}))}
    tree, back = [(0, -1)] * (len(rank) + 1), []
    for at, (i, j) in enumerate(pairs):
        best, k = (0, -1), rank[i] - 1
        while k:
            best, k = max(best, tree[k]), k & (k - 1)
        back.append(best[1])
        now, k = (best[0] + size[j] * len(pairs) + 1, at), rank[i]
        while k < len(tree):
            tree[k], k = max(tree[k], now), k + (k & -k)
    at, out, best, k = -1, [], (0, -1), len(rank)
    while k:
        best, k = max(best, tree[k]), k & (k - 1)
    at = best[1]
    while at >= 0:
        out.append(pairs[at])
        at = back[at]
    return out[::-1]


def _aligned_blocks(first: list[int], later: list[int], size: list[int], anchors: list[tuple[int, int]], min_words: int) -> set[int]:
    """Lines of ``later`` in blocks of at least ``min_words`` words (consecutive on both sides) of
    the alignment that holds the ``anchors`` and is patience diff between them."""
    aligned, alo, blo = [], 0, 0
    for i, j in [*anchors, (len(first), len(later))]:
        if alo < i and blo < j:
            aligned += [(alo + x, blo + y) for x, y in patience(first[alo:i], later[blo:j])]
        aligned.append((i, j))
        alo, blo = i + 1, j + 1
    aligned[-1] = (-9, -9)  # the end ends the last block
    found, block = set(), []
    for i, j in aligned:
        if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
            if sum(size[x] for _, x in block) >= min_words:
                found.update(x for _, x in block)
            block = []
        block.append((i, j))
    return found


def common_block_lines(first: list[int], later: list[int], size: list[int], min_words: int = MIN_BLOCK_WORDS) -> list[int]:
    """Lines of ``later`` in blocks shared with ``first`` of at least ``min_words`` words
    (a block: consecutive on both sides), all from alignments. An alignment is anchored on the
    heaviest ascending part, in words, of the runs that no block holds yet, and is patience diff
    between the anchors; its blocks go, and the runs that it could not hold (they stand in
    another order, or overlap) are aligned again. Where anchors of crossing runs leave only
    short blocks, the heaviest run alone is the anchor, so every round settles one run or more
    and none is left."""
    open_, gone = _shared_runs(first, later, size, min_words), set()
    while open_:
        lone = max(open_, key=lambda r: (sum(size[r[0] : r[1]]), -r[0]))
        for runs in (open_, [lone]):
            anchors = _heaviest(list({(i + k, a + k) for a, b, i in runs for k in range(b - a)}), size)
            found = _aligned_blocks(first, later, size, anchors, min_words)
            if not found <= gone:
                break
        gone |= found
        open_ = [r for r in open_ if not gone.issuperset(range(r[0], r[1]))]
    return sorted(gone)


def _shared_runs(first: list[int], later: list[int], size: list[int], min_words: int) -> list[tuple[int, int, int]]:
    """(start, end, place in ``first``) of the shortest runs of ``min_words`` words in ``later`` that
    ``first`` holds too, at their first place there. Linear in both texts."""
    words = dict(zip(later, size, strict=True))  # a line that only first has ends its runs
    place: dict[tuple, int] = {}
    piece: list[int] = []
    for at, h in enumerate([*first, None]):
        if h in words:
            piece.append(h)
            continue
        for a, b in sorted(_runs([words[x] for x in piece], min_words)):
            place.setdefault(tuple(piece[a:b]), at - len(piece) + a)
        piece = []
    return [(a, b, place[run]) for a, b in sorted(_runs(size, min_words)) if (run := tuple(later[a:b])) in place]


def _keyed(docs: DataFrame) -> DataFrame:
    """The place of each row in the document order, as columns without nulls."""
    return docs.withColumns({
        "_no": F.col("doc_id").isNull(),
        "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
        "_tk": F.xxhash64(F.coalesce(F.col("text"), F.lit(""))),
    })


_KEY = ["_no", "_id", "_tk"]


def profiles(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    def run(rows):
        for r in rows:
            h, w, k = profile(r["text"], min_words)
            yield {"_no": r["_no"], "_id": r["_id"], "_tk": r["_tk"], "h": h, "w": w, "k": k}

    schema = "_no boolean, _id long, _tk long, h array<long>, w array<int>, k array<long>"
    return map_batches(_keyed(docs.select("doc_id", "text")), schema, run, [*_KEY, "text"])


def deletions(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(_no, _id, _tk, lines): the line numbers to delete, ascending, of each document that
    loses any."""
    seen = land(profiles(docs, min_words), "line-profiles").dropDuplicates(_KEY)
    keys = seen.select(F.struct(*_KEY).alias("d"), F.explode("k").alias("k"))
    # landed, so that both sides of the join are plain shuffles and a hot key can be split
    firsts = keys.groupBy("k").agg(F.min("d").alias("first"), F.count("*").alias("df")).filter("df > 1").select("k", "first")
    firsts = land(firsts, "line-firsts")
    pairs = keys.join(firsts, "k").filter(F.col("d") != F.col("first")).select(F.col("d").alias("later"), "first").distinct()
    arrays = seen.select(F.struct(*_KEY).alias("d"), "h", "w")
    sides = (
        pairs.join(arrays.select(F.col("d").alias("first"), F.col("h").alias("a")), "first")
        .join(arrays.select(F.col("d").alias("later"), F.col("h").alias("b"), "w"), "later")
        .select("later.*", "a", "b", "w")
    )

    def run(rows):
        for r in rows:
            lines = common_block_lines(r["a"], r["b"], r["w"], min_words)
            if lines:
                yield {"_no": r["_no"], "_id": r["_id"], "_tk": r["_tk"], "lines": lines}

    found = map_batches(sides, "_no boolean, _id long, _tk long, lines array<int>", run, [*_KEY, "a", "b", "w"])
    # a document has at most one partner per key of its own: the lists stay within its length
    return land(found.groupBy(*_KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines")), "line-deletions")


def _without(text: Column, lines: Column) -> Column:
    def cut(t: str | None, gone) -> str | None:
        if t is None or gone is None or not len(gone):
            return t
        gone = set(gone)
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)

    @F.pandas_udf("string")
    def left(texts: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series([cut(t, g) for t, g in zip(texts, numbers, strict=True)], dtype=object)

    return left(text, lines)


def dedup_lines(docs: DataFrame, min_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """The rows and columns of ``docs`` with ``text`` less the deleted blocks (a document
    that is a copy of an earlier one ends empty) and a column ``removed_lines``
    (line numbers in the text as it was).

    Defined cases: a null text stays null; lines without a word join a block only between
    aligned lines and never make one; rows equal in doc_id and text are one document and
    all keep or lose the same lines; of equal ids the text with the smaller hash is the
    earlier; null ids come last; an empty table gives no rows; other columns pass through
    untouched, whatever their names (those starting with ``_`` and ``lines`` included)."""
    names = docs.columns
    bounded_batches(docs.sparkSession)
    out = docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    out = _keyed(out).join(deletions(docs, min_words), _KEY, "left")
    text = _without(F.col("text"), F.col("lines"))
    cols = [text.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in names]
    return out.select(*cols, F.coalesce("lines", F.array().cast("array<int>")).alias("removed_lines"))
