"""Existence bits of a segment: bytes, the lowest bit of the first byte for bucket 0; in JSON as base64."""

from __future__ import annotations

import base64

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of the bitmaps that Spark's bitmap functions work on.
BYTES = 4096


def with_bit(held: bytes, at: int) -> bytes:
    if at < 0 or at >= 8 * BYTES:
        return held
    out = bytearray(held.ljust(at // 8 + 1, b"\0"))
    out[at // 8] |= 1 << at % 8
    return bytes(out)


def has_bit(held: bytes, at: int) -> bool:
    """False outside the bits."""
    return 0 <= at < 8 * len(held) and bool(held[at // 8] >> at % 8 & 1)


def intersect(a: bytes, b: bytes) -> bool:
    return any(x & y for x, y in zip(a, b, strict=False))


def to_text(held: bytes) -> str:
    return base64.b64encode(held).decode()


def from_text(text: str) -> bytes:
    return base64.b64decode(text, validate=True)


def padded(column: Column) -> Column:
    """The form that ``bitmap_count`` and ``bitmap_or_agg`` take."""
    return F.rpad(column, BYTES, F.lit(bytearray(b"\0")))


def get(column: Column, at: Column) -> Column:
    """Whether a bit of a binary is set; false outside."""
    byte = F.conv(F.hex(F.substring(column, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce((at >= 0) & (F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1), F.lit(False))
