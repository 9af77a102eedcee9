"""Sorted sets: tables ``key, member, score``, ordered by score, then member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import LexRange, ScoreRange
from .common import by, count, first_n, indexed, limited, page, replace_key, requested, running, sample, slice_range


def order(rev: bool = False) -> list[Column]:
    """Ascending by score, then member; reversed on both."""
    way = F.desc if rev else F.asc
    return [way("score"), way("member")]


def zrange(z: DataFrame, start: int, stop: int, rev: bool = False) -> DataFrame:
    """ZRANGE, ZREVRANGE: members of an inclusive rank range, with ``idx``."""
    return slice_range(z, order(rev), start, stop)


def zrangebyscore(z: DataFrame, lo, hi, rev: bool = False, offset: int = 0, limit: int = -1) -> DataFrame:
    """ZRANGEBYSCORE, ZREVRANGEBYSCORE: the predicate reaches the scan."""
    return limited(z.filter(ScoreRange.parse(lo, hi).of(F.col("score"))), order(rev), offset, limit)


def zrangebylex(z: DataFrame, lo, hi, rev: bool = False, offset: int = 0, limit: int = -1) -> DataFrame:
    """ZRANGEBYLEX, ZREVRANGEBYLEX: members of a byte-order interval."""
    return limited(z.filter(LexRange.parse(lo, hi).of(F.col("member"))), order(rev), offset, limit)


def zrangestore(z: DataFrame, dst, picked: DataFrame) -> DataFrame:
    """ZRANGESTORE: a range replaces the destination."""
    return replace_key(z, picked.withColumn("key", F.lit(dst)))


def zcard(z: DataFrame) -> DataFrame:
    return count(z, "n")


def zcount(z: DataFrame, lo, hi) -> DataFrame:
    """ZCOUNT of each key; keys without such members have 0."""
    hit = ScoreRange.parse(lo, hi).of(F.col("score"))
    return z.groupBy(*by(z)).agg(F.count_if(hit).alias("n"))


def zlexcount(z: DataFrame, lo, hi) -> DataFrame:
    hit = LexRange.parse(lo, hi).of(F.col("member"))
    return z.groupBy(*by(z)).agg(F.count_if(hit).alias("n"))


def zscore(z: DataFrame, requests: DataFrame) -> DataFrame:
    """ZSCORE, ZMSCORE: scores of ``key, member`` requests, null where absent."""
    return requested(requests, z, [*by(z), "member"])


def zrank(z: DataFrame, rev: bool = False) -> DataFrame:
    """ZRANK, ZREVRANK of every member, from 0; one set may hold most members."""
    return running(z, order(rev), "rank", before=True)


def zrank_of(z: DataFrame, requests: DataFrame, rev: bool = False) -> DataFrame:
    """Ranks of ``key, member`` requests, null where absent: only their keys are ranked."""
    mine = z.join(requests.select(*by(z)).distinct(), by(z), "left_semi")
    return requested(requests, zrank(mine, rev), [*by(z), "member"])


def zadd(z: DataFrame, adds: DataFrame, nx: bool = False, xx: bool = False, gt: bool = False, lt: bool = False, incr: bool = False) -> tuple[DataFrame, DataFrame]:
    """ZADD, ZINCRBY: the new table, and per key ``added``, ``changed``.

    ``adds``: key, member, score and ``seq`` (the order of arrival).  Several
    adds of a member apply in order; only their net effect is stored.
    """
    if nx and (xx or gt or lt) or gt and lt:
        raise ValueError("GT, LT, and/or NX options at the same time are not compatible")
    on = [*by(z), "member"]
    old = F.col("old")
    if not incr:
        # The net effect is a mergeable aggregate: a member written often is reduced before the shuffle.
        net = F.max("score") if gt else F.min("score") if lt else F.min_by("score", "seq") if nx else F.max_by("score", "seq")
        both = z.withColumnRenamed("score", "old").join(adds.groupBy(*on).agg(net.alias("new")), on, "full")
        new = F.col("new")
        take = old.isNull() if nx else old.isNotNull() if xx else F.lit(True)
        if gt or lt:
            take = take & (old.isNull() | (new > old if gt else new < old))
        both = both.withColumn("score", F.when(new.isNotNull() & take, new).otherwise(old))
        return _added(z, both, new.isNotNull())
    new = adds.groupBy(*on).agg(
        F.sort_array(F.collect_list(F.struct("seq", "score"))).alias("xs"),
    )
    both = z.withColumnRenamed("score", "old").join(new, on, "full")

    def step(state: Column, x: Column) -> Column:
        value = F.nanvl(F.coalesce(state, F.lit(0.0)) + x["score"], F.raise_error(F.lit("resulting score is not a number (NaN)")).cast("double"))
        take = F.lit(True)
        if nx:
            take = state.isNull()
        if xx:
            take = state.isNotNull()
        if gt:
            take = take & (state.isNull() | (value > state))
        if lt:
            take = take & (state.isNull() | (value < state))
        return F.when(take, value).otherwise(state)

    score = F.when(F.col("xs").isNull(), old).otherwise(F.aggregate("xs", old, step))
    return _added(z, both.withColumn("score", score), F.col("xs").isNotNull())


def _added(z: DataFrame, both: DataFrame, asked: Column) -> tuple[DataFrame, DataFrame]:
    """The new table, and per key what was added and changed."""
    old = F.col("old")
    reply = both.filter(asked).groupBy(*by(z)).agg(
        F.count_if(old.isNull() & F.col("score").isNotNull()).alias("added"),
        F.count_if(old.isNotNull() & (F.col("score") != old)).alias("changed"),
    )
    return both.filter("score is not null").select(*z.columns), reply


def zincrby(z: DataFrame, adds: DataFrame) -> DataFrame:
    """ZINCRBY: the new table."""
    return zadd(z, adds, incr=True)[0]


def zrem(z: DataFrame, gone: DataFrame) -> DataFrame:
    """ZREM: the table without ``key, member`` rows of ``gone``."""
    return z.join(gone, [*by(z), "member"], "left_anti")


def zpop(z: DataFrame, n: int = 1, highest: bool = False) -> DataFrame:
    """ZPOPMIN, ZPOPMAX: what is popped (a window group limit keeps n rows a key)."""
    return first_n(z, order(highest), n)


def after_zpop(z: DataFrame, n: int = 1, highest: bool = False) -> DataFrame:
    """The members that a pop leaves."""
    return indexed(z, order(highest)).filter(F.col("idx") >= n).drop("idx")


def zremrangebyrank(z: DataFrame, start: int, stop: int) -> DataFrame:
    return z.join(zrange(z, start, stop).drop("idx", "score"), [*by(z), "member"], "left_anti")


def zremrangebyscore(z: DataFrame, lo, hi) -> DataFrame:
    return z.filter(~ScoreRange.parse(lo, hi).of(F.col("score")))


def zremrangebylex(z: DataFrame, lo, hi) -> DataFrame:
    return z.filter(~LexRange.parse(lo, hi).of(F.col("member")))


def as_zset(members: DataFrame) -> DataFrame:
    """A plain set as a sorted set: every score is 1."""
    return members.withColumn("score", F.lit(1.0))


def _combined(inputs: list[DataFrame], weights: list[float] | None, how: str) -> DataFrame:
    """``member, score, n``: scores of all inputs folded in their order; NaN becomes 0."""
    weights = weights or [1.0] * len(inputs)
    if len(weights) != len(inputs):
        raise ValueError("weights must match the inputs")
    parts = []
    for k, (df, w) in enumerate(zip(inputs, weights)):
        if "score" not in df.columns:
            df = as_zset(df)
        parts.append(df.select("member", F.lit(k).alias("i"), F.nanvl(F.col("score") * F.lit(float(w)), F.lit(0.0)).alias("s")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    if how in ("min", "max"):
        score = (F.min if how == "min" else F.max)("s")
    elif how == "sum" and len(inputs) <= 2:
        score = F.nanvl(F.sum("s"), F.lit(0.0))
    elif how == "sum":
        # Pairwise in input order: inf, -inf, 5 gives 5.  One entry an input: bounded.
        xs = F.array_sort(F.collect_list(F.struct("i", "s")))
        score = F.aggregate(xs, F.lit(0.0), lambda a, x: F.nanvl(a + x["s"], F.lit(0.0)))
    else:
        raise ValueError("aggregate is sum, min or max")
    return rows.groupBy("member").agg(score.alias("score"), F.count("*").alias("n"))


def zunion(*inputs: DataFrame, weights: list[float] | None = None, aggregate: str = "sum") -> DataFrame:
    """ZUNION of ``member[, score]`` frames; partial aggregation runs before the shuffle."""
    return _combined(list(inputs), weights, aggregate).drop("n")


def zinter(*inputs: DataFrame, weights: list[float] | None = None, aggregate: str = "sum") -> DataFrame:
    """ZINTER: members that every input has."""
    return _combined(list(inputs), weights, aggregate).filter(F.col("n") == len(inputs)).drop("n")


def zdiff(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """ZDIFF: members and scores of the first that no other has."""
    out = first if "score" in first.columns else as_zset(first)
    for other in rest:
        out = out.join(other.select("member"), "member", "left_anti")
    return out.select("member", "score")


def zintercard(*inputs: DataFrame, limit: int = 0) -> DataFrame:
    """ZINTERCARD: one row ``n``; a limit of 0 is none."""
    hit = zinter(*inputs)
    return (hit.limit(limit) if limit else hit).agg(F.count("*").alias("n"))


def zstore(z: DataFrame, dst, result: DataFrame) -> DataFrame:
    """ZUNIONSTORE, ZINTERSTORE, ZDIFFSTORE: the result replaces the destination; empty deletes it."""
    rest = z.filter(F.col("key") != F.lit(dst))
    return rest.unionByName(result.withColumn("key", F.lit(dst)).select(*z.columns))


def zrandmember(z: DataFrame, n: int, seed: int | str = 0) -> DataFrame:
    return sample(z, "member", n, seed)


def zscan(z: DataFrame, cursor: int, n: int = 10, match: str | None = None) -> DataFrame:
    return page(z, "member", cursor, n, match)
