"""Pieces that the operators of several value types share.

Tables hold many keys; every operator works on all of them at once.  The key is
``key``, or ``db, key`` where a table has databases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.patterns import glob
from ..functions.scalars import range_bounds
from ..sources.shared import written


def by(table: DataFrame) -> list[str]:
    """The key columns of a table."""
    return ["db", "key"] if "db" in table.columns else ["key"]


def count(table: DataFrame, name: str) -> DataFrame:
    """Elements of each key."""
    return table.groupBy(*by(table)).agg(F.count("*").alias(name))


def requested(requests: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Requests in their order, with what the table has for them, or nulls."""
    return requests.join(table, on, "left")


def page(table: DataFrame, element: str, cursor: int, count: int = 10, match: str | None = None, binary: bool = False) -> DataFrame:
    """One page of a scan: elements whose stable hash falls into the cursor's bucket.

    ``count`` is the expected page size for a million elements' worth of
    buckets; the returned frame has ``next_cursor`` (0: the scan is complete).
    Over an immutable snapshot every element is on exactly one page.
    """
    buckets = max(1, count)
    out = table.filter(F.pmod(F.xxhash64(F.col(element)), F.lit(buckets)) == cursor)
    if match is not None:
        out = out.filter(glob(F.col(element), match, binary))
    return out.withColumn("next_cursor", F.lit((cursor + 1) % buckets))


def indexed(table: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """Dense index from 0 of each key's elements."""
    return table.withColumn(name, F.row_number().over(Window.partitionBy(*by(table)).orderBy(*order)) - 1)


def running(table: DataFrame, order: list[Column], name: str, amount: Column | None = None, before: bool = False) -> DataFrame:
    """A running total of each key's elements in ``order``, whatever the size of a key.

    ``amount`` is what is added up (1 if absent, which numbers the elements
    from 1); ``before`` leaves an element's own amount out.  Rows are dealt by
    ranges of key and order and written, so one key may lie in many
    partitions; totals run inside a partition and start from the sum of the
    key's earlier partitions.  Only the first key of a partition can have such
    a sum, so at most one row a partition is broadcast.
    """
    keys = by(table)
    start, own, part = (unused(table, c) for c in ("start", "amount", "part"))
    one = F.lit(1).cast("long") if amount is None else amount
    dealt = table.withColumn(own, one).repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id())
    dealt = written(dealt, "running")
    sums = dealt.groupBy(part, *keys).agg(F.sum(own).alias("sum"))
    # At most a row a partition and one a key; those of one key are one for each partition it lies in.
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(part, *keys, F.sum("sum").over(earlier).alias(start)).filter(F.col(start).isNotNull())
    here = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    inside = dealt.withColumn(name, F.coalesce(F.sum(own).over(here), F.lit(0)))
    same = [F.col(f"a.{part}") == F.col(f"b.{part}"), *(F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys)]
    both = inside.alias("a").join(F.broadcast(starts).alias("b"), same, "left")
    total = F.col(f"a.{name}") + F.coalesce(F.col(f"b.{start}"), F.lit(0))
    return both.select(*(F.col(f"a.`{c}`") for c in table.columns if c != name), total.alias(name))


def unused(table: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not have."""
    taken = {c.lower() for c in table.columns}
    while name in taken:
        name += "_"
    return name


def first_n(table: DataFrame, order: list[Column], n: int, name: str = "idx") -> DataFrame:
    """The first n elements of each key with their index from 0.

    The filter is on the plain row number: then Spark keeps n rows a key before
    the shuffle (a window group limit), so hot keys stay cheap.
    """
    ranked = table.withColumn("_rn", F.row_number().over(Window.partitionBy(*by(table)).orderBy(*order)))
    return ranked.filter(F.col("_rn") <= n).withColumn(name, F.col("_rn") - 1).drop("_rn")


def slice_range(table: DataFrame, order: list[Column], start: int, stop: int) -> DataFrame:
    """Elements of an inclusive index range with ``idx``.

    Ranges counted from the head need only the first ranks of each key.
    """
    if start >= 0 and stop >= 0:
        return first_n(table, order, stop + 1).filter(F.col("idx") >= start)
    n = F.count("*").over(Window.partitionBy(*by(table)))
    ranked = indexed(table, order).withColumn("_n", n)
    lo, hi = range_bounds(start, stop, F.col("_n"))
    return ranked.filter((F.col("idx") >= lo) & (F.col("idx") <= hi)).drop("_n")


def limited(table: DataFrame, order: list[Column], offset: int = 0, limit: int = -1) -> DataFrame:
    """LIMIT of each key: a negative offset gives nothing, a negative limit everything after the offset."""
    if offset < 0:
        return table.limit(0)
    if offset == 0 and limit < 0:
        return table
    kept = indexed(table, order, "_k") if limit < 0 else first_n(table, order, offset + limit, "_k")
    return kept.filter(F.col("_k") >= offset).drop("_k")


def seeded(column: Column, seed: int | str) -> Column:
    """A repeatable random order: the digest of a seed and the element."""
    return F.md5(F.concat(F.lit(str(seed)), column.cast("string")))


def sample(table: DataFrame, element: str, count: int, seed: int | str) -> DataFrame:
    """``count`` > 0: distinct elements of each key; < 0: that many draws with replacement."""
    keys = by(table)
    if count >= 0:
        order = Window.partitionBy(*keys).orderBy(seeded(F.col(element), seed), F.col(element))
        return table.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= count).drop("_r")
    ranked = indexed(table, [F.col(element)], "_i")
    sizes = table.groupBy(*keys).agg(F.count("*").alias("_n"))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(-count - 1))))
    pick = F.pmod(F.xxhash64(F.lit(str(seed)), "draw", *keys), F.col("_n")).cast("int")
    return draws.withColumn("_i", pick).join(ranked, [*keys, "_i"]).drop("_i", "_n")


def replace_key(table: DataFrame, new: DataFrame) -> DataFrame:
    """``*STORE``: the new rows take the place of all rows of their keys."""
    keys = by(table)
    kept = table.join(new.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(new.select(*table.columns))
