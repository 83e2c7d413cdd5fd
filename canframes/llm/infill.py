"""Fill-in-middle transformation as a ``pyarrow.compute`` pipeline.

A text is cut into units (white space with the word after it; white space at the end is a unit
of its own). Per Arrow batch: a mark byte that UTF-8 cannot hold goes behind each unit, the texts
are split there into list arrays, the lists are flattened with the index of their row, every unit
gets its ordinal in the row, three filters by ordinal pick the units of prefix, middle and suffix,
the lists are rebuilt from the counts and joined, and the pieces are joined with their marks by the
form of the row. No step goes over rows or units in Python.

The draws (cut points, form) are SQL functions of a seed and the doc_id, so a repeated task gives
the same result. ``restore`` rebuilds the text from output and form alone, in SQL functions: a
text that holds a mark stays plain, so each mark stands once in any other output."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canframes.llm.common import bounded_batches

SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80
# fixed values: the marks of the three parts, and what a unit is
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_UNIT = rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_MARK = b"\xff"
#: bytes of text that one pass of the pipeline holds (a longer text goes alone)
CHUNK_BYTES = 8 << 20

ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hx FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units,
        CAST('0x' || hx[1:8] AS BIGINT) AS h1, CAST('0x' || hx[9:16] AS BIGINT) AS h2,
        CAST('0x' || hx[17:24] AS BIGINT) AS h3, CAST('0x' || hx[25:32] AS BIGINT) AS h4 FROM d),
n AS (SELECT *, len(units) AS n FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
             WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(units[1:lo], '') AS pre, array_to_string(units[lo + 1:hi], '') AS mid, array_to_string(units[hi + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def _draw(seed: int, k: int) -> Column:
    """The k-th group of eight hex digits of the row's digest, as an unsigned integer."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long")


def _form(fim_percent: int, spm_percent: int) -> Column:
    held = F.col("text") == ""
    for mark in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.col("text").contains(mark)
    return (
        F.when(held | (F.col("h3") % 100 >= fim_percent), "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    )


def _mod(a: pa.Array, m: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, m), m))


def _as(kind: pa.DataType, values: pa.Array) -> pa.Array:
    return pc.cast(values, options=pc.CastOptions(target_type=kind, allow_invalid_utf8=True))


def _rebuilt(units: pa.Array, keep: pa.Array, counts: pa.Array) -> pa.Array:
    """The kept units, as one joined string for each row: ``counts`` of them."""
    offsets = np.concatenate([[0], np.cumsum(counts.to_numpy(zero_copy_only=False), dtype=np.int64)])
    lists = pa.LargeListArray.from_arrays(pa.array(offsets), units.filter(keep))
    return pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))


def transform_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Units, parts and output of the rows (doc_id, text, form, h1, h2)."""
    text, form = _as(pa.large_binary(), batch.column("text")), batch.column("form")
    marked = pc.replace_substring_regex(text, pattern=_UNIT, replacement=rb"\0" + _MARK)
    lists = pc.split_pattern(marked, pattern=_MARK)  # behind the last mark stands one empty item
    n = pc.subtract(pc.cast(pc.list_value_length(lists), pa.int64()), 1)
    more = pc.add(n, 1)
    cuts = [_mod(batch.column(h), more) for h in ("h1", "h2")]
    lo, hi = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    units, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    first = pa.array(np.concatenate([[0], np.cumsum(more.to_numpy(zero_copy_only=False))[:-1]]).astype(np.int64))
    ordinal = pc.subtract(pa.array(np.arange(len(units))), first.take(row))
    in_prefix, from_suffix = pc.less(ordinal, lo.take(row)), pc.greater_equal(ordinal, hi.take(row))
    prefix = _rebuilt(units, in_prefix, lo)
    middle = _rebuilt(units, pc.invert(pc.or_(in_prefix, from_suffix)), pc.subtract(hi, lo))
    suffix = _rebuilt(units, from_suffix, pc.subtract(more, hi))  # with the empty item behind the last mark
    mark = {m: pa.scalar(m.encode(), pa.large_binary()) for m in (PREFIX, SUFFIX, MIDDLE)}
    empty = pa.scalar(b"", pa.large_binary())
    psm = pc.binary_join_element_wise(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle, empty)
    spm = pc.binary_join_element_wise(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle, empty)
    plain = pc.equal(form, "plain")
    output = pc.if_else(plain, text, pc.if_else(pc.equal(form, "psm"), psm, spm))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.cast(pc.utf8_length(_as(pa.large_string(), x)), pa.int64())) for x in (prefix, middle)]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), n, form, *chars, _as(pa.string(), output)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    )


def _chunks(batch: pa.RecordBatch):
    """Slices of a batch with at most ``CHUNK_BYTES`` of text, or one row."""
    sizes = pc.binary_length(_as(pa.large_binary(), batch.column("text"))).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def fill_in_middle(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null
    if plain) and output for every row.

    Defined cases: a null text is the empty text; empty texts and texts that hold a mark stay
    plain; a null doc_id draws as the empty string and stays null; repeated rows give repeated
    results; an empty table gives no rows; other columns of ``docs`` are not looked at."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    src = src.withColumns({f"h{k + 1}": _draw(seed, k) for k in range(4)}).withColumn("form", _form(fim_percent, spm_percent))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from map(transform_batch, _chunks(batch))

    return src.select("doc_id", "text", "form", "h1", "h2").mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    )


def _between(text: Column, start: str, stop: str) -> Column:
    """What stands between two marks that the text holds once each."""
    return F.substring_index(F.substring_index(text, start, -1), stop, 1)


def restore(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made from."""
    prefix = F.when(form == "psm", _between(output, PREFIX, SUFFIX)).otherwise(_between(output, PREFIX, MIDDLE))
    suffix = F.when(form == "psm", _between(output, SUFFIX, MIDDLE)).otherwise(_between(output, SUFFIX, PREFIX))
    whole = F.concat(prefix, F.substring_index(output, MIDDLE, -1), suffix)
    return F.when(form == "plain", output).otherwise(whole)


def digest_columns(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
