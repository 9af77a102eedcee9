"""Scalar functions: index clamps, number texts, sizes and expiry arithmetic."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Bytes that the size estimate adds.
OBJECT_BYTES, EXPIRY_BYTES, SLICE_BYTES, INT_BYTES = 48, 32, 24, 8
LIMIT = (1 << 63) - 1


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def range_bounds(start, stop, length: Column) -> tuple[Column, Column]:
    """First and last index (from 0) of a list-style inclusive range; empty if first > last."""
    start, stop = _column(start).cast("long"), _column(stop).cast("long")
    lo = F.greatest(F.when(start < 0, start + length).otherwise(start), F.lit(0))
    hi = F.least(F.when(stop < 0, stop + length).otherwise(stop), length - 1)
    return lo, hi


def getrange_bounds(start, stop, length: Column) -> tuple[Column, Column]:
    """As :func:`range_bounds` for byte ranges: two negative ends the wrong way
    round are empty as written, and an end below zero clamps to the first byte."""
    start, stop = _column(start).cast("long"), _column(stop).cast("long")
    lo = F.when(start < 0, F.greatest(start, -length) + length).otherwise(start)
    hi = F.least(F.when(stop < 0, F.greatest(stop, -length) + length).otherwise(stop), length - 1)
    hi = F.when((start < 0) & (stop < 0) & (start > stop), F.lit(-1)).otherwise(hi)
    return lo, hi


def is_canonical_int(value: Column) -> Column:
    """Whether a text is a 64-bit integer written the one way it is printed."""
    text = value.cast("string")
    return F.coalesce(text.rlike(r"^(0|-?[1-9][0-9]{0,18})\z") & text.try_cast("bigint").isNotNull(), F.lit(False))


def parse_int(value: Column) -> Column:
    """A strict integer argument, or null: sign and digits only, above the least long."""
    text = value.cast("string")
    number = F.when(text.rlike(r"^[+-]?[0-9]{1,19}\z"), text.try_cast("bigint"))
    return F.when(number != F.expr("bigint('-9223372036854775808')"), number)


def parse_float(value: Column) -> Column:
    """A strict float, or null: no blanks, no NaN, infinities by name."""
    text = F.lower(value.cast("string"))
    inf = F.when(text.rlike(r"^\+?inf(inity)?\z"), F.lit(float("inf"))).when(text.rlike(r"^-inf(inity)?\z"), F.lit(float("-inf")))
    plain = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?\z"), text.try_cast("double"))
    # A finite text that overflows is no float.
    return F.coalesce(inf, F.when(F.abs(plain) < float("inf"), plain))


def format_number(value: float) -> str:
    """Integral below 1e17 as an integer; else the shortest fixed text that reads back."""
    if np.isinf(value):
        return "inf" if value > 0 else "-inf"
    if value == np.trunc(value) and abs(value) < 1e17:
        return str(int(value))
    return np.format_float_positional(value, unique=True, trim="-")


@F.pandas_udf(T.StringType())
def _format_odd(values: pd.Series) -> pd.Series:
    return values.map(format_number, na_action="ignore")


def format_float(value: Column, exact: bool = True) -> Column:
    """Number text of a double.

    Integral values and infinities, and fractions whose plain printing is
    already the fixed form, stay in the JVM; ``exact`` sends the rest (printed
    with an exponent) to a vectorised formatter.
    """
    plain = value.cast("string")
    odd = _format_odd(value) if exact else plain
    return (
        F.when(value == float("inf"), F.lit("inf"))
        .when(value == float("-inf"), F.lit("-inf"))
        .when((value == F.floor(value)) & (F.abs(value) < 1e17), F.floor(value).cast("bigint").cast("string"))
        .otherwise(odd)
    )


def absolute_expiry(amount: Column, unit: str, absolute: bool, now_ms: int) -> Column:
    """Milliseconds at which a key expires; null if the amount is not positive or overflows."""
    scale = {"s": 1000, "ms": 1}[unit]
    ms = F.try_multiply(amount.cast("long"), F.lit(scale).cast("long"))
    at = ms if absolute else F.try_add(ms, F.lit(now_ms).cast("long"))
    return F.when(amount > 0, at)


def value_size(type_: Column, bytes_: Column, count: Column) -> Column:
    """Estimated bytes of a value: integers 8, strings a header more, collections a header an element."""
    return F.when(type_ == "int", F.lit(INT_BYTES)).when(type_ == "string", bytes_ + SLICE_BYTES).otherwise(bytes_ + count * SLICE_BYTES).cast("long")


def object_size(key: Column, expire_at_ms: Column, value_bytes: Column) -> Column:
    """Estimated bytes of a key with its value, header and expiry entry."""
    n = F.octet_length(key)
    return (n + OBJECT_BYTES + F.when(expire_at_ms > 0, n + EXPIRY_BYTES).otherwise(0) + value_bytes).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    """Stable shard of a key; shards must be a power of two."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    return F.pmod(F.xxhash64(key.cast("binary")), F.lit(shards)).cast("int")


def parse_memory(text: str | int) -> int:
    """``1k`` is 1024 bytes and ``1kb`` 1000, likewise m, g, t; ``b`` or nothing is bytes."""
    s = str(text).strip().lower()
    digits = s.rstrip("bkmgt")
    unit = s[len(digits) :]
    units = {"": 1, "b": 1} | {u: 1024**k for k, u in enumerate("kmgt", 1)} | {u + "b": 1000**k for k, u in enumerate("kmgt", 1)}
    if unit not in units or not digits.strip().isdigit():
        raise ValueError(f"invalid memory value {text!r}")
    return int(digits) * units[unit]


def password_digest(value: Column) -> Column:
    """SHA-256 hex of a password."""
    return F.sha2(value.cast("binary"), 256)
