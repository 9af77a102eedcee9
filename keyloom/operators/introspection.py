"""OBJECT, MEMORY, INFO, ACL and client filters as columns and frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import glob
from ..functions.scalars import is_canonical_int, object_size, value_size
from .common import by


@dataclass(frozen=True)
class Thresholds:
    """Sizes up to which collections keep their compact encoding."""

    entries: int = 128
    value: int = 64
    intset: int = 512


def string_encoding(value: Column) -> Column:
    return F.when(is_canonical_int(value), "int").otherwise("raw")


def collection_stats(table: DataFrame, *elements: str) -> DataFrame:
    """Per key: ``n``, ``bytes``, ``longest`` element, ``ints`` (all first elements are integers)."""
    sizes = [F.octet_length(F.col(e)) for e in elements]
    total = sum(sizes[1:], sizes[0])
    return table.groupBy(*by(table)).agg(
        F.count("*").alias("n"),
        F.sum(total).alias("bytes"),
        F.max(F.greatest(*sizes, F.lit(0))).alias("longest"),
        F.bool_and(is_canonical_int(F.col(elements[0]))).alias("ints"),
    )


def collection_encoding(stats: DataFrame, kind: str, limits: Thresholds = Thresholds()) -> DataFrame:
    """OBJECT ENCODING of collections that have not shrunk (promotion is one-way)."""
    full = {"hash": "hashtable", "list": "quicklist", "set": "hashtable", "zset": "skiplist"}[kind]
    compact = F.when((F.col("n") <= limits.entries) & (F.col("longest") <= limits.value), "listpack").otherwise(full)
    if kind == "set":
        compact = F.when(F.col("ints") & (F.col("n") <= limits.intset), "intset").otherwise(compact)
    return stats.withColumn("encoding", compact)


def object_info(k: DataFrame, now_ms: int) -> DataFrame:
    """OBJECT REFCOUNT, FREQ, IDLETIME: one owner a key, and the tracked access columns."""
    return k.select(*by(k), F.lit(1).alias("refcount"), F.coalesce("freq", F.lit(0)).alias("freq"), F.floor((F.lit(now_ms) - F.col("last_access_ms")) / 1000).alias("idletime"))


def memory_usage(k: DataFrame, stats: DataFrame) -> DataFrame:
    """MEMORY USAGE: ``stats`` has ``kind`` (int, string, or a collection), ``bytes``, ``n`` by key."""
    joined = k.join(stats, by(k))
    size = object_size(F.col("key"), F.col("expire_at_ms"), value_size(F.col("kind"), F.col("bytes"), F.col("n")))
    return joined.select(*by(k), size.alias("bytes"))


def info(k: DataFrame, now_ms: int) -> DataFrame:
    """INFO keyspace: keys, keys with expiry, and mean remaining life of each database and type."""
    at = F.col("expire_at_ms")
    alive = (F.coalesce(at, F.lit(0)) == 0) | (at > now_ms)
    return k.filter(alive).groupBy(*[c for c in ("db",) if c in k.columns], "type").agg(F.count("*").alias("keys"), F.count_if(at > 0).alias("expires"), F.avg(F.when(at > 0, at - now_ms)).alias("avg_ttl"))


def slowlog(commands: DataFrame, n: int, threshold_us: int = 10_000) -> DataFrame:
    """SLOWLOG GET: the latest n commands that took long (n a report's size)."""
    return commands.filter(F.col("micros") >= threshold_us).orderBy(F.desc("id")).limit(n)


def command_stats(commands: DataFrame) -> DataFrame:
    """INFO commandstats: calls, time and failures of each command."""
    return commands.groupBy("command").agg(F.count("*").alias("calls"), F.sum("micros").alias("micros"), F.count_if("failed").alias("failed"))


def acl_keys(k: DataFrame, patterns: list[str], column: str = "key") -> DataFrame:
    """Keys (or channels) that any of a user's patterns allows."""
    allowed = F.lit(False)
    for p in patterns:
        allowed = allowed | glob(F.col(column), p)
    return k.filter(allowed)


def clients(sessions: DataFrame, ids: list[int] | None = None, addr: str | None = None, laddr: str | None = None, user: str | None = None, kind: str | None = None, maxage: int | None = None, skip: int | None = None) -> DataFrame:
    """CLIENT LIST, CLIENT KILL: sessions that meet every given filter."""
    tests = [F.col(c) == v for c, v in (("addr", addr), ("laddr", laddr), ("user", user), ("type", kind)) if v is not None]
    if ids is not None:
        tests.append(F.col("id").isin(ids))
    if maxage is not None:
        tests.append(F.col("age") >= maxage)
    if skip is not None:
        tests.append(F.col("id") != skip)
    out = sessions
    for t in tests:
        out = out.filter(t)
    return out
