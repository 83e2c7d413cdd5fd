"""Runs of repeated word sequences, found with a suffix automaton under link-cut access.

The words of a text are appended one by one to a suffix automaton. Its suffix links form a tree
in which the path from the newest state to the root holds all suffixes of what was read. A
link-cut forest keeps the paths in pieces of one colour, the end of the last occurrence of their
words. Appending word ``i`` accesses its path: each piece met on the way gives an earlier end
``e`` and the longest suffix (``length``) that ended there last. A suffix no shorter than the
distance ``d = i - e`` overlaps or touches its earlier copy, so the words from
``i - length - d + 1`` to ``i`` have period ``d`` twice or more: a square. Extended to the right
it is a run; the longest common suffix makes the left end maximal already. Then the whole path
gets the colour ``i``. A smaller period would have shown a later end, so ``d`` is the smallest.

Only stretches that can hold a run are fed to the automaton. A run of at least ``min_length``
words with two periods or more repeats each of its ``min_length // 2``-word windows at its period
or lies beside one that does, so every word of it stands in such a window that occurs twice in
the text. Stretches without such words are skipped without loss (equal hashes of different windows
only add words to look at). A text is read by one task, whatever its length; texts share nothing."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canframes.llm.common import map_batches

MIN_LENGTH = 12
MIN_EXPONENT = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


class SuffixForest:
    """Suffix automaton of an integer sequence whose suffix-link tree is held as a link-cut
    forest of coloured paths. State 0 is no state, state 1 the root; the colour of a path is
    kept at the root of its splay tree."""

    def __init__(self) -> None:
        self.length = [0, 0]
        self.link = [0, 0]
        self.next: list[dict[int, int]] = [{}, {}]
        self.up = [0, 0]  # splay parent, or path parent at the root of a splay tree
        self.left = [0, 0]  # towards the root of the suffix-link tree
        self.right = [0, 0]
        self.colour = [-1, -1]
        self.last = 1
        self.size = 0

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        self.up.append(link)
        self.left.append(0)
        self.right.append(0)
        self.colour.append(-1)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        p = up[x]
        if not p or (left[p] != x and right[p] != x):
            return  # the root of its splay tree already
        path = [x]
        while p and (left[p] == path[-1] or right[p] == path[-1]):
            path.append(p)
            p = up[p]
        top = path[-1]
        self.colour[x] = self.colour[top]
        above = p
        # each step of the loop rotates x above its parent (and first the parent, if both lean alike)
        while up[x] != above or left[above] == x or right[above] == x:
            p = up[x]
            g = up[p]
            if p == top:
                self._rotate(x, p)
                break
            if (left[g] == p) == (left[p] == x):
                self._rotate(p, g)
                self._rotate(x, p)
            else:
                self._rotate(x, p)
                self._rotate(x, g)
            if g == top:
                break
        up[x] = above

    def _rotate(self, x: int, p: int) -> None:
        up, left, right = self.up, self.left, self.right
        g = up[p]
        if left[p] == x:
            inner = right[x]
            left[p] = inner
            right[x] = p
        else:
            inner = left[x]
            right[p] = inner
            left[x] = p
        if inner:
            up[inner] = p
        up[p] = x
        up[x] = g
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x

    def _insert_above(self, state: int, between: int) -> None:
        """``between`` becomes the parent of ``state``, on the same path."""
        self._splay(state)
        ancestors = self.left[state]
        self.left[state] = 0
        self.up[between] = self.up[state]
        self.up[state] = between
        self.left[between], self.right[between] = ancestors, state
        if ancestors:
            self.up[ancestors] = between
        self.colour[between] = self.colour[state]

    def append(self, symbol: int) -> list[tuple[int, int]]:
        """Read a symbol; (earlier end, longest suffix that ended there last), longest first."""
        nxt, link, length = self.next, self.link, self.length
        i = self.size
        self.size += 1
        p = self.last
        new = self._state(length[p] + 1, {}, 1)
        while p and symbol not in nxt[p]:
            nxt[p][symbol] = new
            p = link[p]
        if p:
            q = nxt[p][symbol]
            if length[q] != length[p] + 1:
                clone = self._state(length[p] + 1, dict(nxt[q]), link[q])
                self._insert_above(q, clone)
                link[q] = clone
                while p and nxt[p].get(symbol) == q:
                    nxt[p][symbol] = clone
                    p = link[p]
                q = clone
            link[new] = self.up[new] = q
        self.last = new
        return self._access(new, i)

    def _access(self, x: int, end: int) -> list[tuple[int, int]]:
        up, right, colour, length = self.up, self.right, self.colour, self.length
        met, below = [], 0
        while x:
            self._splay(x)
            e = colour[x]
            if e >= 0 and length[x]:
                met.append((e, length[x]))
            deeper = right[x]
            if deeper:
                colour[deeper] = e  # stays a path of its own, x is its path parent
            right[x] = below
            below = x
            x = up[x]
        colour[below] = end
        return met


def stretch_runs(symbols: list[int], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start, then period."""
    forest, n = SuffixForest(), len(symbols)
    until: dict[int, int] = {}  # period -> end of its last run found
    runs = []
    for i, s in enumerate(symbols):
        for e, length in forest.append(s):
            d = i - e
            if d <= length and until.get(d, -1) < i:
                stop = i + 1
                while stop < n and symbols[stop] == symbols[stop - d]:
                    stop += 1
                until[d] = stop - 1
                start = i - length - d + 1
                if stop - start >= max(min_length, MIN_EXPONENT * d):
                    runs.append((start, stop - start, d))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def repeated_stretches(ids: np.ndarray, window: int) -> list[tuple[int, int]]:
    """[start, stop) stretches of the words that stand in a window occurring twice or more."""
    if len(ids) <= window:
        return []
    x = (ids.astype(np.uint64) + np.uint64(1)) * _ODD
    x ^= x >> np.uint64(29)
    m = len(x) - window + 1
    h = x[:m].copy()
    for k in range(1, window):
        h = (h ^ (h >> np.uint64(31))) * _ODD + x[k : k + m]
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return []
    at = np.flatnonzero(np.isin(h, twice))
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    covered = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    turn = np.flatnonzero(np.diff(covered))
    return list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))


def word_runs(words: list, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal stretch with smallest period ``period`` and at
    least ``max(min_length, 2 * period)`` words, by start, then period."""
    if len(words) < min_length:
        return []
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    if len(seen) == len(words):
        return []
    found = []
    for start, stop in repeated_stretches(ids, max(1, min_length // 2)):
        if stop - start >= min_length:
            found += [(start + s, n, d) for s, n, d in stretch_runs(ids[start:stop].tolist(), min_length)]
    return found


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that stand in no run after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def words_of(doc_id: int | None, text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").split()  # bytes: only ASCII white space


def with_periodic_tail(doc_id: int | None, text: str | None) -> list[bytes]:
    """The words of a text; for one doc_id in ten (by crc32) the words from a drawn place on
    repeat with a drawn period. A null doc_id changes nothing."""
    words = words_of(doc_id, text)
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, words: Callable[[int | None, str | None], list[bytes]] = words_of) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period) and collapsed (the words that stand
    in no run after its first period, joined by one space) for every row. ``words`` cuts a row
    (doc_id, text) into words.

    Defined cases: a null or empty text has no words, no runs and an empty collapsed text; a null
    doc_id stays null; repeated rows give repeated results; an empty table gives no rows; other
    columns of ``docs`` are not looked at."""

    def run(rows):
        for r in rows:
            own = words(r["doc_id"], r["text"])
            runs = word_runs(own, min_length)
            yield {
                "doc_id": r["doc_id"], "n_words": len(own),
                "runs": [{"start": s, "length": n, "period": d} for s, n, d in runs],
                "collapsed": b" ".join(kept_words(own, runs)).decode("utf-8", "replace"),
            }

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return map_batches(src, schema, run, ["doc_id", "text"])


def run_columns(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) and the digests of each row."""
    ranked = F.transform("runs", lambda r: F.struct((-r["length"]).alias("by"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    best = F.col("best")
    return found.withColumn("best", F.array_min(ranked)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
