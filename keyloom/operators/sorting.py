"""SORT, SORT_RO: elements of lists, sets and sorted sets in numeric or byte order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import parse_float
from .common import by, indexed, limited, replace_key


def sort(table: DataFrame, element: str = "value", alpha: bool = False, desc: bool = False, offset: int = 0, limit: int = -1) -> DataFrame:
    """Each key's elements with ``idx`` in sorted order; ties by bytes; DESC reverses both.

    Without ALPHA an element that is no number is an error.
    """
    way = F.desc if desc else F.asc
    rows = table
    order = [way(element)]
    if not alpha:
        bad = F.raise_error(F.lit("One or more scores can't be converted into double")).cast("double")
        rows = rows.withColumn("_number", F.coalesce(parse_float(F.col(element)), bad))
        order = [way("_number"), way(element)]
    out = limited(rows, order, offset, limit)
    return indexed(out, order).drop("_number")


def sort_store(lists: DataFrame, dst, result: DataFrame, element: str = "value") -> DataFrame:
    """SORT ... STORE: the result becomes the list ``dst``; empty deletes it."""
    new = result.select(*[c for c in by(lists) if c != "key"], F.lit(dst).alias("key"), F.col("idx").cast("long").alias("pos"), F.col(element).alias("value"))
    rest = lists.filter(F.col("key") != F.lit(dst))
    return replace_key(rest, new)
