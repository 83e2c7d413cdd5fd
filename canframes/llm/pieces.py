"""SentencePiece encoding and decoding over a relational lattice.

A text is normalised as the model asks for (a leading space, spaces as the mark U+2581) and
cut into *units* that no piece crosses: before every run of marks, and between letters and
other characters where the piece table has no such piece (checked on the table, else units
are whole words). Each distinct unit of the corpus is segmented once:

1. its substrings up to the longest piece are exploded and equi-joined to the piece table
   (a vocabulary of fixed size, broadcast; a character without a piece stands for its bytes);
2. the edges met are grouped by unit, in the partitioning the distinct units already have;
3. the best path is a Viterbi fold over the edges by end position: highest summed score, of equal
   ones the longest last piece. It runs over all units of an Arrow batch at a time; the few units of
   more than ``_SHORT`` characters go one by one, with ``aggregate``.

Texts are then encoded in Arrow batches from the unit dictionary, without a shuffle of
texts. The most frequent units up to ``max_dictionary_bytes`` are broadcast in packed form
(a stated bound). If the corpus has more units than that, the texts that hold one of the
rest get those units from a shuffle join and are encoded the same way."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canframes.llm.common import Shared, bounded_batches, map_batches, scoped_setting
from canframes.llm.spans import let
from canframes.session import land

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
DICTIONARY_BYTES = 96 << 20
_LETTERS = "A-Za-zÀ-ɏ"
_OTHER = re.compile(f"[^{_LETTERS}{MARK}]|{MARK}{MARK}")
_BLOCK = 256


@dataclass
class PieceTable:
    """The pieces of a model: (piece, id, score) of ordinary pieces, ids of the byte pieces
    (None without byte fallback) and of the unknown piece."""

    pieces: list[tuple[str, int, float]]
    byte_ids: list[int] | None
    unknown: int
    dummy_prefix: bool = True

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)

    @property
    def unknown_score(self) -> float:
        return min((s for _, _, s in self.pieces), default=0.0) - 10.0

    def useful(self) -> list[tuple[str, int, float]]:
        """The pieces that can stand on a best path: not those whose own characters have a
        better path of other pieces (any path through such a piece could be improved)."""
        score, longest = {p: s for p, _, s in self.pieces}, self.longest

        def apart(p: str) -> float:
            best = [0.0] + [-np.inf] * len(p)
            for e in range(1, len(p) + 1):
                for b in range(max(0, e - longest), e):
                    if (b, e) != (0, len(p)):
                        best[e] = max(best[e], best[b] + score.get(p[b:e], -np.inf))
            return best[-1]

        return [(p, i, s) for p, i, s in self.pieces if len(p) == 1 or apart(p) <= s]

    def most_ending(self, of_letters: bool) -> int:
        """How many pieces can end at one position at most, in a unit of letters (behind one mark) or in
        any unit: those that do are suffixes of the longest of them. One more for a character
        without a piece."""
        known = {p for p, _, _ in self.useful() if not of_letters or not _OTHER.search(p)}
        return 1 + max((sum(p[k:] in known for k in range(len(p))) for p in known), default=0)

    def mixed(self) -> bool:
        """Whether a piece goes across letters and other characters."""
        across = re.compile(f"[{_LETTERS}][^{_LETTERS}{MARK}]|[^{_LETTERS}{MARK}][{_LETTERS}]")
        return any(across.search(p) for p, _, _ in self.pieces)

    def unit_pattern(self) -> str:
        """A pattern of units that no piece crosses."""
        if any(MARK in p.lstrip(MARK) for p, _, _ in self.pieces):
            raise ValueError("pieces with a space mark behind other characters are not supported")
        if self.mixed():
            return f"{MARK}*[^{MARK}]+|{MARK}+"
        return f"{MARK}*(?:[{_LETTERS}]+|[^{_LETTERS}{MARK}]+)|{MARK}+"

    def bytes_of(self) -> dict[int, bytes]:
        out = {i: p.replace(MARK, " ").encode("utf-8") for p, i, _ in self.pieces}
        out |= {i: bytes([b]) for b, i in enumerate(self.byte_ids or [])}
        return out | {self.unknown: " ⁇ ".encode()}


def load_pieces(path: str = DEFAULT_MODEL) -> PieceTable:
    """The piece table of a SentencePiece model file (read on the driver)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    in_bytes = {sp.id_to_piece(i): i for i in ids if sp.is_byte(i)}
    pieces = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return PieceTable(pieces, [in_bytes[f"<0x{b:02X}>"] for b in range(256)] if in_bytes else None, sp.unk_id())


_BASE = np.uint64(0x9E3779B97F4A7C13)
_BASE_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _byte_values() -> np.ndarray:
    """A drawn 64-bit value for every byte of UTF-8."""
    values = np.random.default_rng(42).integers(1, 1 << 64, 256, dtype=np.uint64)
    values[255] = 0
    return values


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The powers 0 to n - 1, as products of those of a row and those of its end."""
    row = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(4095, base)]))
    ends = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.repeat(row[-1:] * base, n >> 12)]))
    return (ends[:, None] * row).ravel()[:n]


def hash_pieces(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [start, start + size) that fill up a byte array: a polynomial in
    the drawn byte values, mixed with the length. The powers run through the whole array; a stretch is
    then divided by that of its start (the base is odd, so it has an inverse)."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    h = np.add.reduceat(_byte_values()[raw] * _powers(_BASE, len(raw)), starts) * _powers(_BASE_BACK, len(raw))[starts]
    h = (h ^ (h >> np.uint64(32)) ^ sizes.astype(np.uint64)) * _MIX
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def unit_hash(unit: str) -> int:
    """The hash of one unit."""
    raw = np.frombuffer(unit.encode("utf-8"), dtype=np.uint8)
    return int(hash_pieces(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0])


@dataclass
class Cut:
    """The units of a chunk of texts, end to end in one byte array: where each unit starts, its
    size, its hash, and the number of units up to the end of every text."""

    raw: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    hashes: np.ndarray
    ends: np.ndarray

    def strings(self, at: np.ndarray) -> pa.Array:
        """The units at some places, as strings."""
        size = self.sizes[at]
        data = self.raw[_ranges(self.starts[at], size)]
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data.tobytes()))


_OTHERS, _LETTER, _SPACE, _TWO, _THREE = range(5)  # kinds of characters; of first bytes: more bytes tell


class Units:
    """Cuts texts into their units, a chunk at a time, as ``unit_pattern`` says: by the kinds of
    neighbouring characters, in arrays."""

    def __init__(self, table: PieceTable):
        table.unit_pattern()  # raises where units can't be told
        self.prefix = table.dummy_prefix
        letter = re.compile("(?!)" if table.mixed() else f"[{_LETTERS}]")
        self.kinds = np.array([_LETTER if letter.match(chr(c)) else _OTHERS for c in range(1 << 11)], dtype=np.uint8)
        leads = {b: _TWO for b in range(0xC2, 0xE0)} | {MARK.encode()[0]: _THREE}
        self.leads = bytes(self.kinds[:0x80]) + bytes(leads.get(b, _OTHERS) for b in range(0x80, 0x100))

    def normal(self, texts: pa.Array, space: str) -> pa.Array:
        """The texts with ``space`` for spaces, and one before a text that is not empty."""
        texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
        if space != " ":
            texts = pc.replace_substring(texts, " ", space)
        if not self.prefix:
            return texts
        return pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(space, pa.large_string()), texts, pa.scalar("", pa.large_string())))

    def kind(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The kinds of the characters that start at some places. Characters of three or more bytes are
        no letters here."""
        kinds = np.frombuffer(raw.tobytes().translate(self.leads), dtype=np.uint8)[at]
        after = lambda which, k: raw[np.minimum(at[which] + k, len(raw) - 1)]
        two, three = np.flatnonzero(kinds == _TWO), np.flatnonzero(kinds == _THREE)
        kinds[two] = self.kinds[(after(two, 0) & 0x1F).astype(np.int64) << 6 | after(two, 1) & 0x3F]
        _, second, third = MARK.encode()
        kinds[three] = np.where((after(three, 1) == second) & (after(three, 2) == third), _SPACE, _OTHERS)
        return kinds

    def __call__(self, texts: pa.Array) -> Cut:
        offsets, raw = _contents(self.normal(texts, MARK))
        begins = offsets[:-1][offsets[1:] > offsets[:-1]]
        new = (raw & 0xC0) != 0x80
        new[begins] = True
        at = np.flatnonzero(new)
        kinds = self.kind(raw, at)
        new[at[1:]] = (kinds[1:] != kinds[:-1]) & (kinds[:-1] != _SPACE)
        new[begins] = True
        starts = np.flatnonzero(new)
        sizes = np.diff(starts, append=len(raw))
        return Cut(raw, starts, sizes, hash_pieces(raw, starts, sizes), np.searchsorted(starts, offsets[1:]))


def _contents(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the values, bytes) of a large string array, from its first value on."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw


_OPEN_UNITS = 200_000  # distinct units a task counts before it hands them on
_CHUNK_CHARS = 400_000
_ENCODE_CHARS = 200_000  # beside the dictionary


def _chunks(batch: pa.RecordBatch, chars: int):
    """Slices of a batch with about ``chars`` bytes of text."""
    yield from _slices(batch, pc.binary_length(batch["text"]), chars)


def _slices(batch: pa.RecordBatch, sizes: pa.Array, most: int):
    """Slices of a batch whose sizes add up to about ``most``."""
    ends, at = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most)))
        yield batch.slice(at, stop - at)
        at = stop


def count_units(texts: DataFrame, table: PieceTable) -> DataFrame:
    """(unit, h, n) of the column ``text``. Tasks count in Arrow batches and hand on at most
    about ``_OPEN_UNITS`` units at a time; Spark sums them up."""
    cut = Units(table)

    def run(batches):
        open_, held = [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(open_).group_by(["unit", "h"]).aggregate([("n", "sum")]).rename_columns(["unit", "h", "n"])

        for batch in batches:
            for part in _chunks(batch, _CHUNK_CHARS):
                found = cut(part["text"])
                h, first, n = np.unique(found.hashes, return_index=True, return_counts=True)
                open_.append(pa.table([found.strings(first), pa.array(h), pa.array(n)], names=["unit", "h", "n"]))
                held += len(h)
                if held >= _OPEN_UNITS:
                    open_ = [summed()]
                    held = open_[0].num_rows
                    if held >= _OPEN_UNITS // 2:
                        yield from open_[0].to_batches()
                        open_, held = [], 0
        if open_:
            yield from summed().to_batches()

    return texts.select("text").mapInArrow(run, "unit string, h long, n long").groupBy("unit", "h").agg(F.sum("n").alias("n"))


UNITS_PER_TASK = 20_000
_HEAD = 3  # characters that bound how long a piece can go on


def _small_table(spark, rows: list[tuple[str, int]], text: str, number: str) -> DataFrame:
    """(text, number) as an Arrow table: rows in a list would be pickled anew by Python workers on the
    executors, which stay there beside those of the encoding."""
    data = pa.table([pa.array([t for t, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int32())], names=[text, number])
    return spark.createDataFrame(data, f"{text} string, {number} int")


def lattice(units: DataFrame, table: PieceTable) -> DataFrame:
    """(h, unit, n, edges): every piece that stands somewhere in a unit as one number, with
    its end, its length and its place + 1 among the useful pieces in the bits from high to
    low, sorted; place -1 for a character without a piece. ``units`` is a landed
    table (unit, h, n); its size sets the number of tasks, so that none spills."""
    useful = [(p, k) for k, (p, _, _) in enumerate(table.useful())]
    pieces = F.broadcast(_small_table(units.sparkSession, useful, "piece", "place"))
    longest = max((len(p) for p, _ in useful), default=1)
    tasks = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-units.count() // UNITS_PER_TASK))
    dealt = units.repartition(tasks, "h").withColumn("size", F.length("unit"))
    starts = dealt.select("h", "unit", "n", "size", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("start"))
    # no substring is longer than the longest piece with its first characters
    reach: dict[str, int] = {}
    for p, _ in useful:
        reach[p[:_HEAD]] = max(reach.get(p[:_HEAD], 0), len(p))
    heads = F.broadcast(_small_table(units.sparkSession, [x for x in reach.items() if len(x[0]) == _HEAD], "head", "reach"))
    starts = starts.withColumn("head", F.substring(F.col("unit"), F.col("start"), F.lit(_HEAD))).join(heads, "head", "left")
    ends = F.sequence(F.lit(1), F.least(F.coalesce("reach", F.lit(min(_HEAD - 1, longest))), F.col("size") - F.col("start") + 1))
    parts = starts.select("h", "unit", "n", "start", F.explode(ends).alias("len"))
    parts = parts.withColumn("piece", F.substring(F.col("unit"), F.col("start"), F.col("len")))
    met = parts.join(pieces, "piece", "left").filter("place IS NOT NULL OR len = 1")
    end = F.shiftleft((F.col("start") + F.col("len") - 1).cast("bigint"), 32)
    edge = end + F.shiftleft(F.col("len").cast("bigint"), 24) + F.coalesce("place", F.lit(-1)) + 1
    # grouped by the hash first, which sorts faster than the text
    return met.groupBy("h", "unit", "n").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def _place(code: Column) -> Column:
    """Place + 1 of the piece among the useful ones; 0 for a character without a piece."""
    return code.bitwiseAND(F.lit((1 << 24) - 1)).cast("int")


def _len(code: Column) -> Column:
    return F.shiftright(code, 24).bitwiseAND(F.lit(255)).cast("int")


def best_path(edges: Column, size: Column, scores: Column, longest: int, most: Column) -> Column:
    """Codes of the best path over ``edges`` (sorted codes); ``scores`` by place + 1. The
    fold goes over the positions; at most ``most`` edges end at one, so those that end here
    are among the next ``most`` edges. The state is the number of edges done and, for
    the last ``longest`` positions, the best score and path; a path is a list of full blocks
    and an open one, since appending copies the open one."""
    block = F.array().cast("array<bigint>")
    first = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<array<bigint>>").alias("full"), block.alias("block"))

    def step(acc: Column, end: Column) -> Column:
        here = F.filter(F.slice(edges, acc["done"] + 1, most), lambda x: F.shiftright(x, 32) == end)

        def extend(own: Column) -> Column:
            window = acc["window"]
            before = lambda code: F.get(window, F.size(window) - _len(code))
            best = F.array_max(F.transform(own, lambda x: F.struct((before(x)["s"] + F.get(scores, _place(x))).alias("s"), x.alias("code"))))

            def take(b: Column) -> Column:
                def push(path: Column) -> Column:
                    more = F.concat(path["block"], F.array(b["code"]))
                    full = F.size(path["block"]) >= _BLOCK - 1
                    entry = F.when(full, F.struct(b["s"].alias("s"), F.concat(path["full"], F.array(more)).alias("full"), block.alias("block"))).otherwise(
                        F.struct(b["s"].alias("s"), path["full"].alias("full"), more.alias("block"))
                    )
                    grown = F.concat(window, F.array(entry))
                    return F.struct(
                        (acc["done"] + F.size(own)).alias("done"),
                        F.when(F.size(window) >= longest, F.slice(grown, 2, longest)).otherwise(grown).alias("window"),
                    )

                return let(before(b["code"]), push)

            return let(best, take)

        return let(here, extend)

    zero = F.struct(F.lit(0).alias("done"), F.array(first).alias("window"))
    last = F.aggregate(F.sequence(F.lit(1).cast("bigint"), size.cast("bigint")), zero, step, lambda acc: F.element_at(acc["window"], -1))
    return let(last, lambda x: F.flatten(F.concat(x["full"], F.array(x["block"]))))


_SHORT = 64


def short_path(edges: Column, size: Column, scores: Column) -> Column:
    """The same for units of few positions: the state is the best (score, code) of every position,
    each a back pointer by its length, and one walk back from the end gives the path. The state
    grows by one small entry a position, so no path is copied. ``segment`` does this by batches
    (``Paths``), at a fraction of the time; this is the form in SQL that it is tested against."""
    first = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("code")))

    def step(best: Column, end: Column) -> Column:
        here = F.filter(edges, lambda x: F.shiftright(x, 32) == end)
        ways = F.transform(here, lambda x: F.struct((F.get(best, end.cast("int") - _len(x))["s"] + F.get(scores, _place(x))).alias("s"), x.alias("code")))
        return F.concat(best, F.array(F.array_max(ways)))

    def back(best: Column) -> Column:
        none = F.struct(size.alias("at"), F.array().cast("array<bigint>").alias("path"))

        def walk(acc: Column, end: Column) -> Column:
            code = F.get(best, end)["code"]
            taken = F.struct((end - _len(code)).alias("at"), F.concat(F.array(code), acc["path"]).alias("path"))
            return F.when(acc["at"] == end, taken).otherwise(acc)

        return F.aggregate(F.sequence(size, F.lit(1), F.lit(-1)), none, walk, lambda acc: acc["path"])

    return let(F.aggregate(F.sequence(F.lit(1).cast("bigint"), size.cast("bigint")), first, step), back)


def _constants(values: list, kind: str) -> Column:
    """A constant array: one literal once the plan is optimised, however long."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


@dataclass
class Paths:
    """Best paths of a batch of units over their edges (codes as ``lattice`` gives them), all units one
    end position after the other: the same sums and choices as ``short_path``, as array work."""

    scores: np.ndarray  # by place + 1
    ids: np.ndarray  # by place + 1
    byte_ids: np.ndarray | None
    unknown: int

    @staticmethod
    def of(table: PieceTable) -> Paths:
        useful = table.useful()
        scores = np.array([table.unknown_score, *[s for _, _, s in useful]])
        ids = np.array([-1, *[i for _, i, _ in useful]], dtype=np.int32)
        return Paths(scores, ids, np.array(table.byte_ids, dtype=np.int32) if table.byte_ids else None, table.unknown)

    def taken(self, codes: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether each edge is on its unit's best path. ``first``: where the edges of each unit start,
        and their number; ``sizes``: characters of each unit."""
        cells = np.concatenate([[0], np.cumsum(sizes + 1)])  # one for every position of every unit
        end = codes >> 32
        length = (codes >> 24) & 255
        order = np.argsort(end.astype(np.int32), kind="stable")  # edges by end, then unit, then length
        end, length = end[order], length[order]
        at = np.repeat(cells[:-1], np.diff(first))[order] + end
        before, gain = at - length, self.scores[(codes & ((1 << 24) - 1))[order]]
        groups = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        cell, edges_to = at[groups], np.searchsorted(end, np.arange(1, int(end[-1]) + 2))
        groups_to = np.searchsorted(groups, edges_to)
        best, total = np.zeros(cells[-1]), np.empty(len(codes))
        for k in range(len(edges_to) - 1):
            lo, hi, g, h = edges_to[k], edges_to[k + 1], groups_to[k], groups_to[k + 1]
            total[lo:hi] = best[before[lo:hi]] + gain[lo:hi]
            best[cell[g:h]] = np.maximum.reduceat(total[lo:hi], groups[g:h] - lo)
        win = np.flatnonzero(total == best[at])
        last = np.zeros(cells[-1], dtype=np.int64)
        last[at[win]] = win  # of equal ones the longest, which comes last
        taken = np.zeros(len(codes), dtype=bool)
        start, here = cells[:-1], cells[:-1] + sizes
        while len(here):
            step = last[here]
            taken[order[step]] = True
            here = here - length[step]
            left = here > start
            start, here = start[left], here[left]
        return taken

    def spelled(self, units: pa.Array, edges: pa.Array) -> pa.Array:
        """The piece ids of every unit."""
        first = edges.offsets.to_numpy()
        codes = edges.values.to_numpy()[first[0] : first[-1]]
        first = first.astype(np.int64) - first[0]
        sizes = codes[first[1:] - 1] >> 32  # the last edge ends the unit
        taken = self.taken(codes, first, sizes)
        codes, of = codes[taken], np.repeat(np.arange(len(sizes)), np.diff(first))[taken]
        place = codes & ((1 << 24) - 1)
        made, n = self.ids[place], np.ones(len(codes), dtype=np.int64)
        alone = place == 0
        if alone.any():
            if self.byte_ids is None:
                made[alone] = self.unknown
            else:
                _, raw = _contents(pc.cast(units, pa.large_string()))
                chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # where characters start
                char = (np.cumsum(sizes) - sizes)[of[alone]] + (codes[alone] >> 32) - 1
                n[alone] = chars[char + 1] - chars[char]
                made = np.repeat(made, n)
                made[np.repeat(alone, n)] = self.byte_ids[raw[_ranges(chars[char], n[alone])]]
        count = np.bincount(of, weights=n, minlength=len(sizes)).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(made, pa.int32()))


_EDGES = 200_000  # of a batch that are worked on at a time


def segment(units: DataFrame, table: PieceTable) -> DataFrame:
    """(h, unit, n, ids): the piece ids of every distinct unit of a landed table (unit, h, n)."""
    few = F.length("unit") <= _SHORT
    paths = Shared(units.sparkSession, Paths.of(table))

    def run(batches):
        for batch in batches:
            for part in _slices(batch, pc.list_value_length(batch["edges"]), _EDGES):
                ids = paths.value.spelled(part["unit"], part["edges"])
                yield pa.RecordBatch.from_arrays([part["h"], part["unit"], part["n"], ids], names=["h", "unit", "n", "ids"])

    short = lattice(units.filter(few), table).mapInArrow(run, "h long, unit string, n long, ids array<int>")
    long = units.filter(~few)
    return short if long.isEmpty() else short.unionByName(_segment_long(long, table))


def _segment_long(units: DataFrame, table: PieceTable) -> DataFrame:
    """The same for units of many positions, with paths in blocks."""
    useful = table.useful()
    scores = _constants([table.unknown_score, *[s for _, _, s in useful]], "double")
    longest = max((len(p) for p, _, _ in useful), default=1)
    most = F.when(F.col("unit").rlike(_OTHER.pattern), F.lit(table.most_ending(False))).otherwise(F.lit(table.most_ending(True)))
    path = let(most, lambda m: best_path(F.col("edges"), F.length("unit"), scores, longest, m))
    if table.byte_ids:
        byte_ids = _constants(table.byte_ids, "int")

        def spelled(code: Column) -> Column:
            char = F.hex(F.substring(F.col("unit"), F.shiftright(code, 32).cast("int"), F.lit(1)).cast("binary"))
            return F.transform(F.sequence(F.lit(1), F.length(char), F.lit(2)), lambda i: F.get(byte_ids, F.conv(F.substring(char, i, F.lit(2)), 16, 10).cast("int")))
    else:
        spelled = lambda code: F.array(F.lit(table.unknown))
    ids = _constants([-1, *[i for _, i, _ in useful]], "int")
    each = F.transform(path, lambda c: F.when(_place(c) > 0, F.array(F.get(ids, _place(c)))).otherwise(spelled(c)))
    return lattice(units, table).select("h", "unit", "n", F.flatten(each).alias("ids"))


@dataclass
class Dictionary:
    """Packed unit -> ids: sorted 64-bit unit hashes, offsets, ids."""

    keys: np.ndarray
    offsets: np.ndarray
    ids: np.ndarray

    @staticmethod
    def of(rows: DataFrame, largest_id: int) -> Dictionary:
        """Of (h, ids), sorted by Spark, so that the driver only lays chunks end to end."""
        small = largest_id < 1 << 15
        got = rows.select("h", F.col("ids").cast("array<smallint>" if small else "array<int>").alias("ids")).orderBy("h").toArrow()
        lay = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
        keys = lay([c.to_numpy() for c in got["h"].chunks], np.int64)
        sizes = lay([c.value_lengths().to_numpy() for c in got["ids"].chunks], np.int32)
        ids = lay([c.flatten().to_numpy() for c in got["ids"].chunks], np.int16 if small else np.int32)
        return Dictionary(keys, np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)]), ids)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first id, number of ids) of each key; -1 ids where a key is missing."""
        if not len(self.keys) or not len(keys):
            return np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        order = np.argsort(keys)  # lookups in ascending order stay in the cache
        at = np.empty(len(keys), dtype=np.int64)
        at[order] = np.minimum(np.searchsorted(self.keys, keys[order]), len(self.keys) - 1)
        size = np.where(self.keys[at] == keys, self.offsets[at + 1] - self.offsets[at], -1)
        return self.offsets[at].astype(np.int64), size.astype(np.int64)


@dataclass
class Spelling:
    """The bytes of every id in one buffer, for decoding without a loop over the ids."""

    offsets: np.ndarray
    buffer: np.ndarray
    prefix: bool

    @staticmethod
    def of(table: PieceTable) -> Spelling:
        raw = table.bytes_of()
        each = [raw.get(i, b"") for i in range(max(raw) + 1)]
        return Spelling(np.concatenate([[0], np.cumsum([len(x) for x in each])]), np.frombuffer(b"".join(each), dtype=np.uint8), table.dummy_prefix)

    def raw(self, ids) -> bytes:
        x = np.asarray(ids, dtype=np.int64)
        x = x[(x >= 0) & (x < len(self.offsets) - 1)]
        return self.buffer[_ranges(self.offsets[x], self.offsets[x + 1] - self.offsets[x])].tobytes()

    def text(self, ids) -> str:
        raw = self.raw(ids)
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated ranges begin[i] .. begin[i] + size[i] - 1."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return np.arange(total) + shift


def _decode_alike(cut: Units, texts: pa.Array, ids: np.ndarray, ends: np.ndarray, spell: Spelling) -> list[bool]:
    """Whether the ids of each text (up to ``ends``) decode to it: the bytes of all emitted ids, cut
    at the texts, against the bytes of the texts with their leading space."""
    size = spell.offsets[ids + 1] - spell.offsets[ids]
    made = spell.buffer[_ranges(spell.offsets[ids], size)]
    at = np.concatenate([[0], np.concatenate([[0], np.cumsum(size)])[ends]])
    offsets, raw = _contents(cut.normal(texts, " "))
    if len(made) == len(raw) and (at == offsets).all():
        wrong = np.concatenate([[0], np.cumsum(made != raw)])
        return (wrong[offsets[1:]] == wrong[offsets[:-1]]).tolist()
    return [made[a:b].tobytes() == raw[c:d].tobytes() for a, b, c, d in zip(at[:-1], at[1:], offsets[:-1], offsets[1:], strict=True)]


def _encode_batches(table: PieceTable, shared, spelling: Shared, missing: bool):
    """mapInArrow function over (key columns..., text[, more]): ids, or with ``missing`` the
    hashes of the distinct units that the broadcast dictionary lacks. ``more`` maps the hashes of a
    text's rare units to ids. With the ids comes ``round_trip``: whether they decode to the text."""
    cut = Units(table)

    def run(batches):
        d, spell = Dictionary(*(x.value for x in shared)), spelling.value
        for batch in batches:
            names = batch.schema.names
            keep = [i for i, n in enumerate(names) if n not in ("text", "more")]
            for part in _chunks(batch, _ENCODE_CHARS):
                found = cut(part["text"])
                units, of = np.unique(found.hashes, return_inverse=True)  # token -> place among the chunk's units
                begin, size = d.find(units)
                head = [part.column(i) for i in keep]
                if missing:
                    lack = [np.unique(x[size[x] < 0]) for x in np.split(of, found.ends[:-1])]
                    value = pa.array([units[x] for x in lack], type=pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*head, value], names=[names[i] for i in keep] + ["units"])
                    continue
                pool = d.ids
                if "more" in names:
                    extra = {e["h"]: e["ids"] for x in part["more"].to_pylist() for e in x or []}
                    keys = np.array(sorted(extra), dtype=np.int64)
                    own = np.searchsorted(units, keys)
                    lengths = np.array([len(extra[k]) for k in keys.tolist()], dtype=np.int64)
                    begin[own], size[own] = len(pool) + np.cumsum(lengths) - lengths, lengths
                    pool = np.concatenate([pool.astype(np.int32), np.array([i for k in keys.tolist() for i in extra[k]], dtype=np.int32)])
                if len(size) and size.min() < 0:
                    raise ValueError("a unit of the text is in no dictionary")
                ids = pool[_ranges(begin[of], size[of])].astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(size[of])])[found.ends]
                value = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                same = _decode_alike(cut, part["text"], ids, ends, spell)
                yield pa.RecordBatch.from_arrays([*head, pa.array(same, pa.bool_()), value], names=[names[i] for i in keep] + ["round_trip", "ids"])

    return run


def encode(docs: DataFrame, table: PieceTable | None = None, max_dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip) for every row: the piece ids of the whole text and
    whether decoding them gives the text back (a mark U+2581 in a text decodes to a space, so that
    such a text does not come back).

    Defined cases: a null or empty text has no ids (an empty array); a null doc_id stays
    null; repeated rows give repeated results; an empty table gives no rows; other columns
    are not looked at. Characters without a piece become their byte pieces (without byte
    fallback the unknown id)."""
    table = table or load_pieces()
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = land(count_units(src, table), "piece-counts")
    # a task of the lattice groups about UNITS_PER_TASK units: few enough to group without sorting
    with scoped_setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(4 * UNITS_PER_TASK)):
        known = land(segment(counted, table), "piece-units")
    cost = F.lit(14) + F.lit(2) * F.size("ids")  # packed bytes of a unit
    at_least = _frequency_bound(known, cost, max_dictionary_bytes)
    frequent = Dictionary.of(known.filter(F.col("n") >= at_least), max([table.unknown, *(i for _, i, _ in table.pieces), *(table.byte_ids or [])]))
    # three broadcasts, so that a worker holds one of them twice at most while it reads them
    shared = [spark.sparkContext.broadcast(x) for x in (frequent.keys, frequent.offsets, frequent.ids)]
    del frequent
    spelling = Shared(spark, Spelling.of(table))
    result = "doc_id long, round_trip boolean, ids array<int>"
    if at_least > 1:
        rare = known.filter(F.col("n") < at_least).select("h", "ids")
        keyed = src.withColumn("key", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
        lacks = keyed.mapInArrow(_encode_batches(table, shared, spelling, True), "doc_id long, key string, units array<long>")
        more = (
            lacks.select("key", F.explode("units").alias("h")).distinct().join(rare, "h")
            .groupBy("key").agg(F.collect_list(F.struct("h", "ids")).alias("more"))
        )
        more = land(more, "piece-more")  # landed, so that a text that many rows hold can be split
        src = keyed.join(more, "key", "left").select("doc_id", "text", "more")
    return src.mapInArrow(_encode_batches(table, shared, spelling, False), result).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


def _frequency_bound(known: DataFrame, cost: Column, max_bytes: int) -> int:
    """The smallest count whose units, and all more frequent ones, fit ``max_bytes``; counts
    are grouped by powers of two first, so at most 64 rows reach the driver."""
    level = F.floor(F.log2(F.col("n"))).cast("int")
    sizes = {r["level"]: r["bytes"] for r in known.groupBy(level.alias("level")).agg(F.sum(cost).alias("bytes")).collect()}
    total, bound = 0, 1 << 63
    for lv in sorted(sizes, reverse=True):
        total += sizes[lv]
        if total > max_bytes:
            return min(bound, (1 << 62))
        bound = 1 << lv
    return 1


def decode(encoded: DataFrame, table: PieceTable | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): pieces joined, byte pieces as UTF-8, marks as spaces,
    the leading space of the normal form dropped. A null ``ids`` gives a null text; ids
    outside the table are left out."""
    spelling = Shared(encoded.sparkSession, Spelling.of(table or load_pieces()))

    def run(rows):
        for r in rows:
            yield {"doc_id": r["doc_id"], "text": None if r["ids"] is None else spelling.value.text(r["ids"])}

    return map_batches(encoded, "doc_id long, text string", run, ["doc_id", "ids"])
