"""Sets: tables ``key, member`` of distinct members."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import by, count, page, requested, sample, seeded


def sadd(m: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SADD: the new table, and members added by key."""
    fresh = new.select(*m.columns).distinct().join(m, m.columns, "left_anti")
    return m.unionByName(fresh), count(fresh, "added")


def srem(m: DataFrame, gone: DataFrame) -> DataFrame:
    return m.join(gone, [*by(m), "member"], "left_anti")


def scard(m: DataFrame) -> DataFrame:
    return count(m, "n")


def smembers(m: DataFrame) -> DataFrame:
    """SMEMBERS as one array a key (for keys known to be small); the table itself is the scalable form."""
    return m.groupBy(*by(m)).agg(F.array_sort(F.collect_set("member")).alias("members"))


def smismember(m: DataFrame, requests: DataFrame) -> DataFrame:
    """SISMEMBER, SMISMEMBER: ``is_member`` 0 or 1 for each request."""
    found = requested(requests, m.withColumn("_in", F.lit(1)), [*by(m), "member"])
    return found.withColumn("is_member", F.coalesce("_in", F.lit(0))).drop("_in")


def spop(m: DataFrame, n: int, seed: int | str) -> tuple[DataFrame, DataFrame]:
    """SPOP: what is chosen (the rows to log as removed), and what is left."""
    chosen = sample(m, "member", n, seed)
    return chosen, srem(m, chosen)


def srandmember(m: DataFrame, n: int, seed: int | str = 0) -> DataFrame:
    return sample(m, "member", n, seed)


def smove(m: DataFrame, src, dst, member) -> DataFrame:
    """SMOVE: moves a member if the source has it."""
    there = m.filter((F.col("key") == F.lit(src)) & (F.col("member") == F.lit(member)))
    if src == dst:
        return m
    moved = there.withColumn("key", F.lit(dst)).select(*m.columns)
    rest = m.filter(~((F.col("key") == F.lit(src)) & (F.col("member") == F.lit(member))))
    return rest.unionByName(moved).distinct()


def members(m: DataFrame, key) -> DataFrame:
    return m.filter(F.col("key") == F.lit(key)).select("member")


def sinter(*inputs: DataFrame) -> DataFrame:
    """SINTER of ``member`` frames: one aggregation, whatever the number of inputs."""
    rows = inputs[0]
    for other in inputs[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("member").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(inputs)).drop("_n")


def sinter_keys(m: DataFrame, keys: list) -> DataFrame:
    """SINTER of keys of one table: a single scan; a missing key empties it."""
    keys = list(dict.fromkeys(keys))
    hit = m.filter(F.col("key").isin(keys))
    return hit.groupBy("member").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(keys)).drop("_n")


def sunion(*inputs: DataFrame) -> DataFrame:
    rows = inputs[0]
    for other in inputs[1:]:
        rows = rows.unionByName(other)
    return rows.distinct()


def sdiff(first: DataFrame, *rest: DataFrame) -> DataFrame:
    for other in rest:
        first = first.join(other, "member", "left_anti")
    return first


def sstore(m: DataFrame, dst, result: DataFrame) -> DataFrame:
    """SINTERSTORE, SUNIONSTORE, SDIFFSTORE: the result replaces the destination; empty deletes it."""
    rest = m.filter(F.col("key") != F.lit(dst))
    return rest.unionByName(result.withColumn("key", F.lit(dst)).select(*m.columns))


def sintercard(*inputs: DataFrame, limit: int = 0) -> DataFrame:
    hit = sinter(*inputs)
    return (hit.limit(limit) if limit else hit).agg(F.count("*").alias("n"))


def sscan(m: DataFrame, cursor: int, n: int = 10, match: str | None = None) -> DataFrame:
    return page(m, "member", cursor, n, match)


def randomkey(keys: DataFrame, seed: int | str = 0) -> DataFrame:
    """RANDOMKEY: one key in seeded order."""
    return keys.orderBy(seeded(F.col("key"), seed), "key").limit(1)
