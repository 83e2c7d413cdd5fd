"""Content keys and deterministic shuffle keys (replace Python row loops and RNG state)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canframes.schema import FEATURES, SEED


def payload_text(features: list[str] | None = None) -> Column:
    """Canonical text of a float32 payload: the values joined by commas."""
    features = features or FEATURES
    return F.concat_ws(",", *[F.col(c).cast("float").cast("string") for c in features])


def row_hash(features: list[str] | None = None) -> Column:
    """sha1 hex of the payload: equal payloads share a key (the leakage group)."""
    return F.sha1(payload_text(features))


def salted_hash(key: str | Column, seed: int = SEED) -> Column:
    """Seeded pseudo-random order of a key: sha1 of ``<seed>:<key>`` (40 hex chars)."""
    col = F.col(key) if isinstance(key, str) else key
    return F.sha1(F.concat(F.lit(f"{seed}:"), col.cast("string")))


def shuffle_key(frame_key: str | Column, seed: int = SEED) -> Column:
    """Deterministic seeded shuffle order of frames; sort by it only where order matters."""
    return salted_hash(frame_key, seed)


def float32_hex(c: str | Column) -> Column:
    """Hex of the four bytes of a value as IEEE-754 float32, little-endian, by arithmetic (JVM
    expressions). Exponent and fraction of a float32 are exact in double; null and NaN give the
    quiet NaN. The exponent comes from the logarithm: the largest float32 under a power of two
    is 8.6e-8 below it there, so 1e-8 settles rounding without passing the power."""
    col = (F.col(c) if isinstance(c, str) else c).cast("float")
    size = F.abs(col.cast("double"))
    exponent = F.greatest(F.coalesce(F.floor(F.log2(size) + 1e-8), F.lit(-126)), F.lit(-126))
    finite = ((exponent + 126) * (1 << 23) + size * F.pow(F.lit(2.0), 23 - exponent)).cast("long")
    bits = (
        F.when(col.isNull() | F.isnan(col), F.lit(0x7FC00000))
        .when(size == float("inf"), F.lit(0x7F800000))
        .otherwise(finite)
    )
    negative = col.cast("string").startswith("-")  # tells -0.0 from 0.0
    text = F.lpad(F.hex(bits.cast("long") + F.when(negative, F.lit(1 << 31)).otherwise(F.lit(0))), 8, "0")
    return F.concat(*[F.substring(text, at, 2) for at in (7, 5, 3, 1)])


def row_hash_bytes(features: list[str] | None = None) -> Column:
    """sha1 hex of the row's float32 payload bytes (little-endian, contiguous): the same digest
    as hashing the raw float32 vector. Use when the digests themselves must match, ``row_hash``
    when only the groups must."""
    return F.sha1(F.unhex(F.concat(*[float32_hex(c) for c in features or FEATURES])))
