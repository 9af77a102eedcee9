"""Keys of any type: tables ``key, type, expire_at_ms, ...``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import glob
from ..functions.scalars import absolute_expiry
from .common import by, page
from .live import live

#: No expiry, for comparisons.
NEVER = 9223372036854775807


def delete(table: DataFrame, gone: DataFrame) -> DataFrame:
    """DEL, UNLINK: the table (of any kind) without the keys of ``gone``."""
    return table.join(gone.select(*by(table)).distinct(), by(table), "left_anti")


def exists(keys: DataFrame, requests: DataFrame) -> DataFrame:
    """EXISTS, TOUCH: one row ``n``; a key named twice counts twice."""
    return requests.join(keys.select(*by(keys)), by(keys), "left_semi").agg(F.count("*").alias("n"))


def touch(keys: DataFrame, requests: DataFrame, now_ms: int) -> DataFrame:
    """TOUCH: the key table with the access clock of the requested keys set."""
    hit = requests.select(*by(keys)).distinct().withColumn("_hit", F.lit(True))
    out = keys.join(hit, by(keys), "left")
    return out.withColumn("last_access_ms", F.when(F.col("_hit"), F.lit(now_ms)).otherwise(F.col("last_access_ms"))).drop("_hit")


def type_of(keys: DataFrame, requests: DataFrame) -> DataFrame:
    """TYPE of each request, ``none`` where missing."""
    return requests.join(keys.select(*by(keys), "type"), by(keys), "left").withColumn("type", F.coalesce("type", F.lit("none")))


def rename(table: DataFrame, src, dst) -> DataFrame:
    """RENAME in any table: the source's rows, with their expiry, replace the destination's."""
    if src == dst:
        return table
    key = F.col("key")
    return table.filter(key != F.lit(dst)).withColumn("key", F.when(key == F.lit(src), F.lit(dst)).otherwise(key))


def renamenx_allowed(keys: DataFrame, src, dst) -> bool:
    """RENAMENX: whether the destination is free (a key itself is not) and the source there."""
    found = {r.key for r in keys.filter(F.col("key").isin([src, dst])).select("key").distinct().collect()}  # two keys at most
    if src not in found:
        raise KeyError("no such key")
    return dst not in found


def copy(table: DataFrame, src, dst, db: int | None = None) -> DataFrame:
    """COPY ... REPLACE in any table: the destination becomes a copy of the source, expiry included."""
    mine = table.filter(F.col("key") == F.lit(src)).withColumn("key", F.lit(dst))
    there = F.col("key") == F.lit(dst)
    if db is not None:
        mine = mine.withColumn("db", F.lit(db))
        there = there & (F.col("db") == db)
    elif src == dst:
        raise ValueError("source and destination objects are the same")
    return table.filter(~there).unionByName(mine.select(*table.columns))


def move_mapping(table: DataFrame, mapping: DataFrame) -> DataFrame:
    """RENAME for many keys at once: ``mapping`` is ``key, new_key`` with distinct keys and new keys.

    Targets that are not sources themselves are replaced.
    """
    moved = mapping.join(table.select("key").distinct(), "key", "left_semi")
    gone = moved.select(F.col("new_key").alias("key")).join(moved.select("key"), "key", "left_anti")
    out = table.join(gone, "key", "left_anti").join(moved, "key", "left")
    return out.withColumn("key", F.coalesce("new_key", "key")).select(*table.columns)


def keys(k: DataFrame, pattern: str, binary: bool = False) -> DataFrame:
    """KEYS: a regular expression in the scan, no shuffle."""
    return k.filter(glob(F.col("key"), pattern, binary))


def scan(k: DataFrame, cursor: int, n: int = 10, match: str | None = None, kind: str | None = None) -> DataFrame:
    """SCAN: one page; an unknown type gives nothing."""
    return page(k if kind is None else k.filter(F.col("type") == kind), "key", cursor, n, match)


def dbsize(k: DataFrame, now_ms: int) -> DataFrame:
    """DBSIZE of each database, expired keys left out."""
    return live(k, now_ms).groupBy(*[c for c in ("db",) if c in k.columns]).agg(F.count("*").alias("n"))


def expire(k: DataFrame, requests: DataFrame, now_ms: int, unit: str = "s", absolute: bool = False, condition: str | None = None) -> DataFrame:
    """EXPIRE, PEXPIRE, EXPIREAT, PEXPIREAT: the new key table.

    ``requests`` is ``key, amount`` and, where a key may be asked for more than
    once, ``seq``, their order (without it, by amount).  Amounts that are not
    positive are errors; an instant that has passed deletes.  NX, XX, GT, LT
    look at the old expiry, where none counts as infinite.
    """
    condition = condition and condition.lower()
    # The net effect of a key's requests: of NX the first takes, of GT and LT the extreme, else the last.
    order = F.struct(*[c for c in ("seq", "amount") if c in requests.columns])
    net = {"nx": F.min_by("amount", order), "gt": F.max("amount"), "lt": F.min("amount")}.get(condition, F.max_by("amount", order))
    requests = requests.groupBy(*by(k)).agg(net.alias("amount"), F.min("amount").alias("_least"))
    bad = F.raise_error(F.lit("invalid expire time")).cast("long")
    at = F.coalesce(absolute_expiry(F.col("amount"), unit, absolute, now_ms), bad)
    # One wrong amount is an error, whichever request takes.
    at = F.when(F.col("_least") <= 0, bad).otherwise(at)
    out = live(k, now_ms).join(requests.withColumn("_at", at).drop("amount", "_least"), by(k), "left")
    old = F.when(F.coalesce("expire_at_ms", F.lit(0)) == 0, F.lit(NEVER)).otherwise(F.col("expire_at_ms"))
    tests = {None: F.lit(True), "nx": old == NEVER, "xx": old != NEVER, "gt": F.col("_at") > old, "lt": F.col("_at") < old}
    take = F.col("_at").isNotNull() & tests[condition]
    out = out.withColumn("expire_at_ms", F.when(take, F.col("_at")).otherwise(F.col("expire_at_ms")))
    return live(out, now_ms).select(*k.columns)


def persist(k: DataFrame, requests: DataFrame) -> DataFrame:
    """PERSIST: the new key table."""
    hit = requests.select(*by(k)).distinct().withColumn("_hit", F.lit(True))
    out = k.join(hit, by(k), "left")
    return out.withColumn("expire_at_ms", F.when(F.col("_hit"), F.lit(0)).otherwise(F.col("expire_at_ms")).cast("long")).select(*k.columns)


def ttl(expire_at_ms: Column, now_ms: int, unit: str = "s") -> Column:
    """TTL, PTTL: seconds round up; -1 without expiry, -2 for a dead or missing key."""
    at = F.coalesce(expire_at_ms, F.lit(0))
    left = at - F.lit(now_ms)
    shown = F.ceil(left / 1000).cast("long") if unit == "s" else left.cast("long")
    return F.when(expire_at_ms.isNull(), F.lit(-2)).when(at == 0, F.lit(-1)).when(left <= 0, F.lit(-2)).otherwise(shown).cast("long")


def expiretime(expire_at_ms: Column, now_ms: int, unit: str = "s") -> Column:
    """EXPIRETIME, PEXPIRETIME: the instant itself, seconds rounded up."""
    at = F.coalesce(expire_at_ms, F.lit(0))
    shown = F.ceil(at / 1000).cast("long") if unit == "s" else at.cast("long")
    return F.when(expire_at_ms.isNull(), F.lit(-2)).when(at == 0, F.lit(-1)).when(at <= now_ms, F.lit(-2)).otherwise(shown).cast("long")


def swapdb(table: DataFrame, a: int, b: int) -> DataFrame:
    """SWAPDB in any table."""
    db = F.col("db")
    return table.withColumn("db", F.when(db == a, F.lit(b)).when(db == b, F.lit(a)).otherwise(db))


def flush(table: DataFrame, db: int | None = None) -> DataFrame:
    """FLUSHDB, FLUSHALL."""
    return table.limit(0) if db is None else table.filter(F.col("db") != db)
