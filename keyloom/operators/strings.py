"""Strings: tables ``key, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import format_float, getrange_bounds, parse_float, parse_int
from .common import by, running


def get(s: DataFrame, keys: list) -> DataFrame:
    return s.filter(F.col("key").isin(keys))


def mget(s: DataFrame, requests: DataFrame) -> DataFrame:
    """MGET: values of ``pos, key`` requests in order; null for missing keys and other types."""
    return requests.join(s, by(s), "left").orderBy("pos")


def put(s: DataFrame, new: DataFrame, nx: bool = False, xx: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """SET, MSET, SETNX: ``new`` is ``key, seq, value``; the last write wins (NX: the first).

    ``keys``: all live keys of any type, which NX and XX look at.
    """
    on = by(s)
    pick = F.min_by if nx else F.max_by
    last = new.groupBy(*on).agg(pick("value", "seq").alias("value"))
    there = (keys if keys is not None else s).select(*on)
    if nx:
        last = last.join(there, on, "left_anti")
    if xx:
        last = last.join(there, on, "left_semi")
    return s.join(last.select(*on), on, "left_anti").unionByName(last.select(*s.columns))


def msetnx(s: DataFrame, new: DataFrame, keys: DataFrame) -> DataFrame:
    """MSETNX: all or nothing; any existing key of any type refuses the whole set."""
    taken = new.join(keys.select(*by(s)), by(s), "left_semi").limit(1)
    # At most one row, with one column: refuses by an anti-join on a constant.
    return put(s, new.withColumn("_one", F.lit(1)).join(F.broadcast(taken.select(F.lit(1).alias("_one"))), "_one", "left_anti").drop("_one"))


def getset(log: DataFrame, order: str = "seq") -> DataFrame:
    """GETSET replies over a log of writes: the value before each."""
    return log.withColumn("old", F.lag("value").over(Window.partitionBy(*by(log)).orderBy(order)))


def getdel(s: DataFrame, keys: list) -> tuple[DataFrame, DataFrame]:
    """GETDEL: the values, and the table without them."""
    hit = F.col("key").isin(keys)
    return s.filter(hit), s.filter(~hit)


def incr_running(deltas: DataFrame, order: str = "seq", s: DataFrame | None = None) -> DataFrame:
    """INCR, DECR, INCRBY, DECRBY replies: the running value of each counter.

    A counter starts from its stored value in ``s``, or from zero.  A stored
    value that is no integer, or a step beyond 64 bits, is an error.  One
    counter may hold most rows: totals run in ranges of ``order``.
    """
    exact = running(deltas, [F.col(order)], "value", F.col("delta").cast("decimal(38,0)"))
    if s is not None:
        on = by(deltas)
        bad = F.raise_error(F.lit("value is not an integer or out of range")).cast("long")
        old = s.join(deltas.select(*on).distinct(), on, "left_semi").select(*on, F.coalesce(parse_int(F.col("value")), bad).alias("_old"))
        exact = exact.join(old, on, "left").withColumn("value", F.col("value") + F.coalesce("_old", F.lit(0))).drop("_old")
    over = F.raise_error(F.lit("increment or decrement would overflow")).cast("long")
    fits = F.col("value").between(F.lit(-(1 << 63)).cast("decimal(38,0)"), F.lit((1 << 63) - 1).cast("decimal(38,0)"))
    return exact.withColumn("value", F.when(fits, F.col("value").cast("long")).otherwise(over))


def incrby(s: DataFrame, deltas: DataFrame) -> DataFrame:
    """INCRBY: the new table; no integer, or an overflow, is an error; time to live is not touched."""
    on = by(s)
    sums = deltas.groupBy(*on).agg(F.sum("delta").alias("delta"))
    both = s.join(sums, on, "full")
    bad = F.raise_error(F.lit("value is not an integer or out of range")).cast("long")
    over = F.raise_error(F.lit("increment or decrement would overflow")).cast("long")
    old = F.when(F.col("value").isNull(), F.lit(0).cast("long")).otherwise(F.coalesce(parse_int(F.col("value")), bad))
    new = F.coalesce(F.try_add(old, F.col("delta")), over)
    kind = dict(s.dtypes)["value"]
    return both.withColumn("value", F.when(F.col("delta").isNull(), F.col("value")).otherwise(new.cast("string").cast(kind))).select(*s.columns)


def incrbyfloat(s: DataFrame, deltas: DataFrame) -> DataFrame:
    """INCRBYFLOAT: deltas apply in ``seq`` order; NaN or infinity is an error."""
    on = by(s)
    xs = deltas.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("xs"))
    both = s.join(xs, on, "full")
    old = F.when(F.col("value").isNull(), F.lit(0.0)).otherwise(F.coalesce(parse_float(F.col("value")), F.raise_error(F.lit("value is not a valid float")).cast("double")))
    new = F.aggregate("xs", old, lambda a, x: a + x["delta"])
    bad = F.raise_error(F.lit("value is not a valid float")).cast("double")
    new = F.when(F.isnan(new) | (F.abs(new) == float("inf")), bad).otherwise(new)
    kind = dict(s.dtypes)["value"]
    return both.withColumn("value", F.when(F.col("xs").isNull(), F.col("value")).otherwise(format_float(new).cast(kind))).select(*s.columns)


def append(s: DataFrame, new: DataFrame) -> DataFrame:
    """APPEND: pieces join in ``seq`` order. The new table; a length is ``strlen`` of it."""
    on = by(s)
    xs = new.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("xs"))
    kind = dict(s.dtypes)["value"]
    both = s.join(xs, on, "full")
    start = F.coalesce(F.col("value").cast("binary"), F.lit(b""))
    joined = F.when(F.col("xs").isNull(), F.col("value").cast("binary")).otherwise(F.aggregate("xs", start, lambda a, x: F.concat(a, x["value"].cast("binary"))))
    return both.withColumn("value", joined.cast(kind)).select(*s.columns)


def strlen(value: Column) -> Column:
    """Bytes of a value; 0 if missing."""
    return F.coalesce(F.octet_length(value), F.lit(0))


def getrange(value: Column, start, stop) -> Column:
    """GETRANGE, SUBSTR: an inclusive range of bytes (or of characters of an ASCII text)."""
    lo, hi = getrange_bounds(start, stop, F.octet_length(value).cast("long"))
    return F.substring(value, (lo + 1).cast("int"), F.greatest(hi - lo + 1, F.lit(0)).cast("int"))


def setrange(value: Column, offset: int, patch) -> Column:
    """SETRANGE: overwrite from a byte offset, zero bytes fill a gap; an empty patch changes nothing."""
    if offset < 0:
        raise ValueError("offset is out of range")
    patch = patch.encode() if isinstance(patch, str) else patch
    if not patch:
        return value
    base = F.coalesce(value.cast("binary"), F.lit(b""))
    # rpad cuts what is longer, so it only fills gaps.
    base = F.when(F.octet_length(base) < offset, F.rpad(base, offset, F.lit(b"\x00"))).otherwise(base)
    return F.overlay(base, F.lit(patch), F.lit(offset + 1), F.lit(len(patch)))
