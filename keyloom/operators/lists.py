"""Lists: tables ``key, pos, value``; ``pos`` orders a list and may be sparse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import by, count, first_n, indexed, slice_range

LEFT, RIGHT = "left", "right"


def _order(rev: bool = False) -> list:
    return [F.desc("pos") if rev else F.asc("pos")]


def dense(l: DataFrame) -> DataFrame:
    """``idx`` from 0 in list order."""
    return indexed(l, _order())


def push(l: DataFrame, new: DataFrame, side: str = RIGHT, existing_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """LPUSH, RPUSH, LPUSHX, RPUSHX: ``new`` is ``key, seq, value``. The new table, and lengths."""
    keys = by(l)
    ends = l.groupBy(*keys).agg((F.min if side == LEFT else F.max)("pos").alias("_end"))
    ranked = new.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("seq")))
    placed = ranked.join(ends, keys, "inner" if existing_only else "left")
    step = F.col("_k") if side == RIGHT else -F.col("_k")
    end = F.coalesce("_end", F.lit(-1 if side == RIGHT else 0))
    placed = placed.withColumn("pos", (end + step).cast("long"))
    out = l.unionByName(placed.select(*l.columns))
    return out, count(out.join(placed.select(*keys).distinct(), keys, "left_semi"), "n")


def pop(l: DataFrame, n: int = 1, side: str = LEFT) -> tuple[DataFrame, DataFrame]:
    """LPOP, RPOP: what is popped, in pop order (``idx``), and what is left."""
    order = _order(side == RIGHT)
    return first_n(l, order, n), indexed(l, order).filter(F.col("idx") >= n).drop("idx")


def llen(l: DataFrame) -> DataFrame:
    return count(l, "n")


def lindex(l: DataFrame, i: int) -> DataFrame:
    """LINDEX of every list; lists too short have no row."""
    if i >= 0:
        return first_n(l, _order(), i + 1).filter(F.col("idx") == i).drop("idx", "pos")
    return first_n(l, _order(True), -i).filter(F.col("idx") == -i - 1).drop("idx", "pos")


def lset(l: DataFrame, i: int, value) -> DataFrame:
    """LSET: out of range in any list is an error."""
    n = F.count("*").over(Window.partitionBy(*by(l)))
    at = F.lit(i) if i >= 0 else n + i
    out = dense(l).withColumn("_at", at).withColumn("_n", n)
    bad = F.raise_error(F.lit("index out of range")).cast(dict(l.dtypes)["value"])
    value = F.when((F.col("_at") < 0) | (F.col("_at") >= F.col("_n")), bad).when(F.col("idx") == F.col("_at"), F.lit(value)).otherwise(F.col("value"))
    return out.withColumn("value", value).select(*l.columns)


def lrange(l: DataFrame, start: int, stop: int) -> DataFrame:
    """LRANGE with ``idx`` from the list's head."""
    return slice_range(l, _order(), start, stop)


def ltrim(l: DataFrame, start: int, stop: int) -> DataFrame:
    """LTRIM: what is kept; an empty list is no key."""
    return lrange(l, start, stop).drop("idx")


def linsert(l: DataFrame, pivot, value, after: bool = False) -> DataFrame:
    """LINSERT at the first pivot of each list; lists without it stay as they are."""
    keys = by(l)
    ranked = dense(l).withColumn("pos", F.col("idx") * 2).drop("idx")
    hit = ranked.filter(F.col("value") == F.lit(pivot)).groupBy(*keys).agg(F.min("pos").alias("pos"))
    new = hit.withColumn("pos", F.col("pos") + (1 if after else -1)).withColumn("value", F.lit(value))
    out = ranked.unionByName(new.select(*ranked.columns), allowMissingColumns=False)
    return dense(out).withColumn("pos", F.col("idx").cast("long")).select(*l.columns)


def lrem(l: DataFrame, n: int, value) -> DataFrame:
    """LREM: drops the first n (n < 0: last, 0: all) equal elements of each list."""
    same = F.col("value") == F.lit(value)
    if n == 0:
        return l.filter(~same)
    order = Window.partitionBy(*by(l), "_same").orderBy(*_order(n < 0))
    ranked = l.withColumn("_same", same).withColumn("_k", F.row_number().over(order))
    return ranked.filter(~F.col("_same") | (F.col("_k") > abs(n))).select(*l.columns)


def lpos(l: DataFrame, value, rank: int = 1, n: int | None = None, maxlen: int = 0) -> DataFrame:
    """LPOS: ``idx`` of matches with their ``occurrence`` (from 1, in the direction of ``rank``).

    ``n`` None: the first; 0: all.  ``maxlen`` bounds what is looked at from the
    head, for either direction.
    """
    if rank == 0:
        raise ValueError("RANK can't be zero")
    looked = dense(l)
    if maxlen > 0:
        looked = looked.filter(F.col("idx") < maxlen)
    hits = looked.filter(F.col("value") == F.lit(value))
    order = Window.partitionBy(*by(l)).orderBy(F.asc("idx") if rank > 0 else F.desc("idx"))
    hits = hits.withColumn("occurrence", F.row_number().over(order)).filter(F.col("occurrence") >= abs(rank))
    limit = 1 if n is None else n
    if limit:
        hits = hits.filter(F.col("occurrence") < abs(rank) + limit)
    return hits.select(*by(l), "idx", "occurrence")


def lmove(l: DataFrame, src, dst, from_side: str = RIGHT, to_side: str = LEFT) -> DataFrame:
    """LMOVE, RPOPLPUSH: one element goes from the source's end to the destination's; the same key rotates."""
    source = l.filter(F.col("key") == F.lit(src))
    order = _order(from_side == RIGHT)
    moved = indexed(source, order).filter("idx = 0").drop("idx")
    rest = l.join(moved.select(*by(l), "pos"), [*by(l), "pos"], "left_anti")
    ends = rest.filter(F.col("key") == F.lit(dst)).agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    at = F.coalesce(F.col("_lo") - 1, F.lit(0)) if to_side == LEFT else F.coalesce(F.col("_hi") + 1, F.lit(0))
    # One row on either side.
    placed = moved.drop("pos").join(F.broadcast(ends)).withColumn("pos", at.cast("long")).withColumn("key", F.lit(dst))
    return rest.unionByName(placed.select(*l.columns))
