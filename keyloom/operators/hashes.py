"""Hashes: tables ``key, field, value``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import format_float, parse_float, parse_int
from .common import by, count, page, requested, sample


def _on(h: DataFrame) -> list[str]:
    return [*by(h), "field"]


def hset(h: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """HSET, HMSET: ``new`` has ``seq``; the last write of a field wins. Also the number of new fields."""
    last = new.groupBy(*_on(h)).agg(F.max_by("value", "seq").alias("value"))
    fresh = last.join(h.select(*_on(h)), _on(h), "left_anti")
    kept = h.join(last.select(*_on(h)), _on(h), "left_anti")
    return kept.unionByName(last.select(*h.columns)), count(fresh, "added")


def hsetnx(h: DataFrame, new: DataFrame) -> DataFrame:
    """HSETNX: the first write of an absent field wins."""
    first = new.groupBy(*_on(h)).agg(F.min_by("value", "seq").alias("value"))
    return h.unionByName(first.join(h.select(*_on(h)), _on(h), "left_anti").select(*h.columns))


def hget(h: DataFrame, requests: DataFrame) -> DataFrame:
    """HGET, HMGET: values of ``key, field`` requests, null where absent."""
    return requested(requests, h, _on(h))


def hdel(h: DataFrame, gone: DataFrame) -> DataFrame:
    return h.join(gone, _on(h), "left_anti")


def hlen(h: DataFrame) -> DataFrame:
    return count(h, "n")


def hexists(h: DataFrame, requests: DataFrame) -> DataFrame:
    found = requested(requests, h.select(*_on(h), F.lit(1).alias("_in")), _on(h))
    return found.withColumn("found", F.coalesce("_in", F.lit(0))).drop("_in")


def hstrlen(h: DataFrame) -> DataFrame:
    """HSTRLEN of every field: bytes of its value."""
    return h.withColumn("n", F.octet_length("value")).drop("value")


def hkeys(h: DataFrame) -> DataFrame:
    """HKEYS: values are not read."""
    return h.drop("value")


def hvals(h: DataFrame) -> DataFrame:
    return h.drop("field")


def hgetall(h: DataFrame) -> DataFrame:
    """HGETALL as one map a key (for keys known to be small); the table itself is the scalable form."""
    return h.groupBy(*by(h)).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def hincrby(h: DataFrame, deltas: DataFrame) -> DataFrame:
    """HINCRBY: the new table; a value that is no integer, or an overflow, is an error."""
    sums = deltas.groupBy(*_on(h)).agg(F.sum("delta").alias("delta"))
    both = h.join(sums, _on(h), "full")
    old = F.when(F.col("value").isNull(), F.lit(0).cast("long")).otherwise(parse_int(F.col("value")))
    bad = F.raise_error(F.lit("hash value is not an integer")).cast("long")
    over = F.raise_error(F.lit("increment or decrement would overflow")).cast("long")
    new = F.coalesce(F.try_add(F.coalesce(old, bad), F.col("delta")), over)
    kind = dict(h.dtypes)["value"]
    return both.withColumn("value", F.when(F.col("delta").isNull(), F.col("value")).otherwise(new.cast("string").cast(kind))).select(*h.columns)


def hincrbyfloat(h: DataFrame, deltas: DataFrame) -> DataFrame:
    """HINCRBYFLOAT: deltas apply in ``seq`` order, since float addition is not associative."""
    xs = deltas.groupBy(*_on(h)).agg(F.array_sort(F.collect_list(F.struct("seq", "delta"))).alias("xs"))
    both = h.join(xs, _on(h), "full")
    old = F.when(F.col("value").isNull(), F.lit(0.0)).otherwise(F.coalesce(parse_float(F.col("value")), F.raise_error(F.lit("hash value is not a float")).cast("double")))
    new = F.aggregate("xs", old, lambda a, x: a + x["delta"])
    bad = F.raise_error(F.lit("increment would produce NaN or Infinity")).cast("double")
    new = F.when(F.isnan(new) | (F.abs(new) == float("inf")), bad).otherwise(new)
    kind = dict(h.dtypes)["value"]
    return both.withColumn("value", F.when(F.col("xs").isNull(), F.col("value")).otherwise(format_float(new).cast(kind))).select(*h.columns)


def hrandfield(h: DataFrame, n: int, seed: int | str = 0) -> DataFrame:
    return sample(h, "field", n, seed)


def hscan(h: DataFrame, cursor: int, n: int = 10, match: str | None = None, novalues: bool = False) -> DataFrame:
    out = page(h, "field", cursor, n, match)
    return out.drop("value") if novalues else out
