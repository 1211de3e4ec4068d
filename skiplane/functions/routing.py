"""Routing of values to small integer buckets, as Column expressions and as the same rules in Python for literals.

Categorical values go by 32 bits of their text's MD5, numeric ones by the exact
floor of the base-2 logarithm, clamped to the first and the last bucket.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH, MAGNITUDE = "hash", "magnitude"


def _check(n: int) -> None:
    if n < 1:
        raise ValueError("a dimension needs one bucket at least")


def hash_bucket(value: Column, n: int) -> Column:
    """Null routes like the empty text."""
    _check(n)
    text = F.coalesce(value.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % n).cast("int")


def hash_bucket_of(value: object, n: int) -> int:
    _check(n)
    text = "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % n


def exact_log2(v: Column) -> Column:
    """floor(log2 v) for finite v > 0, corrected by a comparison with the powers on both sides."""
    b = F.floor(F.log2(v))
    two = F.lit(2.0)
    return (b + F.when(v >= F.pow(two, b + 1), 1).otherwise(0) - F.when(v < F.pow(two, b), 1).otherwise(0)).cast("int")


def magnitude_bucket(value: Column, n: int) -> Column:
    """Null, NaN, text that is no number and anything below 1 go to bucket 0; infinity to the last."""
    _check(n)
    v = value.try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (v < 1), 0).when(v >= float(2 ** (n - 1)), n - 1).otherwise(exact_log2(v)).cast("int")


def magnitude_bucket_of(value: float | None, n: int) -> int:
    _check(n)
    if value is None or math.isnan(value) or value < 1:
        return 0
    return n - 1 if value >= 2 ** (n - 1) else math.frexp(value)[1] - 1


def range_buckets(low: float | None, high: float | None, n: int) -> range:
    """Buckets that a closed range touches; an open end is None."""
    _check(n)
    low, high = max(low if low is not None else 0.0, 0.0), high if high is not None else math.inf
    if low > max(high, 0.0):
        return range(0)
    return range(magnitude_bucket_of(low, n), magnitude_bucket_of(high, n) + 1)


def bucket(value: Column, kind: str, n: int) -> Column:
    return magnitude_bucket(value, n) if kind == MAGNITUDE else hash_bucket(value, n)


def bucket_of(value: object, kind: str, n: int) -> int:
    return magnitude_bucket_of(float(value), n) if kind == MAGNITUDE else hash_bucket_of(value, n)  # type: ignore[arg-type]


def bitset_index(bx: Column, by: Column, bz: Column, s: int, t: int) -> Column:
    return bx * (s * t) + by * t + bz


def most_buckets(low: float, high: float) -> int:
    """No more buckets than this are touched by [low, high], 1 <= low <= high."""
    return math.ceil(math.log2(high / low)) + 1


def boolean(text: Column) -> Column:
    """true/1/yes and false/0/no in any case; all else is null."""
    low = F.lower(text)
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)


def refined_label(value: Column, n: int, least: int = -17) -> Column:
    """bK for buckets from 1, and sK for values below 2 by their true magnitude, clamped to least..0."""
    v = value.cast("double")
    sub = F.when(v.isNull() | F.isnan(v) | (v <= 0), least).otherwise(F.greatest(F.least(exact_log2(v), F.lit(0)), F.lit(least)))
    return F.when(v >= 2, F.concat(F.lit("b"), magnitude_bucket(v, n).cast("string"))).otherwise(F.concat(F.lit("s"), sub.cast("string")))


def offset_label(value: Column, k: int, least: int = -10, most: int | None = None) -> Column:
    """Sub-bucket of values in [2**k, 2**(k+1)) by the magnitude of what is beyond 2**k; null outside."""
    v = value.cast("double")
    rest = v - float(2**k)
    most = k - 1 if most is None else most
    return F.when((v >= float(2**k)) & (v < float(2 ** (k + 1))), F.when(rest <= 0, least).otherwise(F.greatest(F.least(exact_log2(rest), F.lit(most)), F.lit(least)))).cast("int")
