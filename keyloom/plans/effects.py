"""Canonical effects: requests resolved against the state before they are logged.

Conditions (NX, XX, GT, LT), relative times, random choices, float results and
cross-key commands are decided here, once.  What is logged replays the same
however late, in whatever order of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import absolute_expiry, format_float
from ..operators.common import sample
from ..operators.eviction import sweep
from .fold import split_keys

#: Verbs a log may hold after canonicalisation.
CANONICAL = "SET DEL PEXPIREAT PERSIST APPEND SETRANGE INCRBY HSET HDEL HINCRBY SADD SREM ZADD ZREM RPUSH LPUSH RPUSHX LPUSHX LPOP RPOP LSET LTRIM LREM LINSERT MSET FLUSHDB FLUSHALL".split()


def effect(rows: DataFrame, verb: str | Column, *args: Column) -> DataFrame:
    """Log rows of requests ``offset, db, key, ...``."""
    verb = F.lit(verb) if isinstance(verb, str) else verb
    return rows.select("offset", "db", verb.alias("verb"), F.array(F.col("key").cast("binary"), *[a.cast("binary") for a in args]).alias("args"))


def text(value: Column) -> Column:
    return value.cast("string").cast("binary")


def set_effects(requests: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """SET, SETNX, SETEX, PSETEX, GETSET.

    ``requests``: offset, db, key, value, nx, xx, keepttl, amount, unit (s or
    ms), absolute.  Requests of one key in a batch are decided in order: after
    the first that applies, the key exists.
    """
    there = keys.select("db", "key", F.lit(True).alias("there"))
    r = requests.join(there, ["db", "key"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    # The key exists for a request if it did, or any plain or NX request came before.
    earlier = Window.partitionBy("db", "key").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    made = F.coalesce(F.max(~F.col("xx")).over(earlier), F.lit(False))
    exists = F.col("there") | made
    r = r.withColumn("exists", exists).filter(~(F.col("nx") & F.col("exists")) & ~(F.col("xx") & ~F.col("exists")))
    at = F.when(
        F.col("amount").isNotNull(),
        F.when(F.col("unit") == "s", F.when(F.col("absolute"), absolute_expiry(F.col("amount"), "s", True, now_ms)).otherwise(absolute_expiry(F.col("amount"), "s", False, now_ms))).otherwise(
            F.when(F.col("absolute"), absolute_expiry(F.col("amount"), "ms", True, now_ms)).otherwise(absolute_expiry(F.col("amount"), "ms", False, now_ms))
        ),
    )
    bad = F.raise_error(F.lit("invalid expire time in 'set' command")).cast("bigint")
    at = F.when(F.col("amount").isNotNull(), F.coalesce(at, bad))
    base = F.array(F.col("key").cast("binary"), F.col("value").cast("binary"))
    extra = F.when(at.isNotNull(), F.array(F.lit(b"PXAT"), text(at))).when(F.col("keepttl"), F.array(F.lit(b"KEEPTTL"))).otherwise(F.array().cast("array<binary>"))
    return r.select("offset", "db", F.lit("SET").alias("verb"), F.concat(base, extra).alias("args"))


def expire_effects(requests: DataFrame, keys: DataFrame, now_ms: int, unit: str = "s", absolute: bool = False, condition: str | None = None) -> DataFrame:
    """The EXPIRE family as PEXPIREAT, or DEL for an instant that has passed."""
    at = absolute_expiry(F.col("amount"), unit, absolute, now_ms)
    at = F.coalesce(at, F.raise_error(F.lit("invalid expire time")).cast("bigint"))
    r = requests.join(keys.select("db", "key", "expire_at_ms"), ["db", "key"]).withColumn("at", at)
    never = F.lit((1 << 63) - 1)
    old = F.when(F.col("expire_at_ms") == 0, never).otherwise(F.col("expire_at_ms"))
    tests = {None: F.lit(True), "nx": old == never, "xx": old != never, "gt": F.col("at") > old, "lt": F.col("at") < old}
    r = r.filter(tests[condition and condition.lower()])
    past = effect(r.filter(F.col("at") <= now_ms), "DEL")
    return past.unionByName(effect(r.filter(F.col("at") > now_ms), "PEXPIREAT", text(F.col("at"))))


def sweep_effects(keys: DataFrame, now_ms: int, offset: int) -> DataFrame:
    """DEL of every key whose time has come."""
    return effect(sweep(keys, now_ms).withColumn("offset", F.lit(offset).cast("bigint")), "DEL")


def spop_effects(m: DataFrame, n: int, seed: int | str, offset: int) -> DataFrame:
    """SPOP as SREM of the members that were chosen."""
    return effect(sample(m, "member", n, seed).withColumn("offset", F.lit(offset).cast("bigint")), "SREM", F.col("member"))


def zadd_effects(before: DataFrame, after: DataFrame, offset: int) -> DataFrame:
    """ZADD with any option, ZINCRBY: plain ZADD of the scores that differ."""
    on = ["db", "key", "member"]
    changed = after.join(before.withColumnRenamed("score", "old"), on, "left").filter("old is null or old <> score")
    return effect(changed.withColumn("offset", F.lit(offset).cast("bigint")), "ZADD", format_float(F.col("score")), F.col("member"))


def zpop_effects(popped: DataFrame, offset: int) -> DataFrame:
    """ZPOPMIN, ZPOPMAX, BZPOP*: ZREM of what was popped."""
    return effect(popped.withColumn("offset", F.lit(offset).cast("bigint")), "ZREM", F.col("member"))


def number_effects(results: DataFrame, offset: int, field: bool = False) -> DataFrame:
    """INCRBYFLOAT as SET ... KEEPTTL, HINCRBYFLOAT as HSET, with the result's text."""
    rows = results.withColumn("offset", F.lit(offset).cast("bigint"))
    if field:
        return effect(rows, "HSET", F.col("field"), F.col("value"))
    return effect(rows, "SET", F.col("value"), F.lit(b"KEEPTTL"))


REBUILD = {"string": ("SET", ("value",)), "hash": ("HSET", ("field", "value")), "set": ("SADD", ("member",)), "zset": ("ZADD", ("score", "member")), "list": ("RPUSH", ("value",))}


def store_effects(kind: str, dst: bytes, elements: DataFrame, offset: int, db: int = 0, expire_at_ms: int = 0) -> DataFrame:
    """RENAME, COPY, SMOVE, LMOVE, SORT STORE, *STORE: delete the target, then rebuild it.

    All rows have the command's offset, so what is logged later stays later;
    ``sub`` orders them: the delete, the elements (lists by ``pos``), the expiry.
    """
    verb, cols = REBUILD[kind]
    spark = elements.sparkSession
    at = F.lit(offset).cast("bigint")
    one = spark.range(1).select(at.alias("offset"), F.lit(db).alias("db"), F.lit(dst).alias("key"))
    rows = elements.withColumns({"db": F.lit(db), "key": F.lit(dst), "offset": at, "sub": F.col("pos") + 1 if kind == "list" else F.lit(1)})
    args = [format_float(F.col(c)) if c == "score" else F.col(c) for c in cols]
    key = F.col("key").cast("binary")
    made = rows.select("offset", F.col("sub").cast("bigint").alias("sub"), "db", F.lit(verb).alias("verb"), F.array(key, *[a.cast("binary") for a in args]).alias("args"))
    out = effect(one, "DEL").withColumn("sub", F.lit(0).cast("bigint")).unionByName(made)
    if expire_at_ms:
        last = effect(one, "PEXPIREAT", F.lit(str(expire_at_ms))).withColumn("sub", F.lit(1 << 38).cast("bigint"))
        # Nothing was stored, nothing expires.
        out = out.unionByName(last.join(F.broadcast(elements.limit(1).select()), how="left_semi"))
    return out.select("offset", "sub", "db", "verb", "args")


def transaction(requests: DataFrame, watched: DataFrame, log: DataFrame) -> DataFrame:
    """MULTI/EXEC with WATCH: the requests whose transaction may run.

    ``requests``: ``txn, offset, ...``; ``watched``: ``txn, db, key, seen``, the
    log's offset at WATCH.  A later effect on a watched key drops the whole
    transaction, whichever place the key has in its record; so does a later
    flush of the key's database.  All effects of one share its epoch.
    """
    rows = split_keys(log)
    touched = rows.filter("key IS NOT NULL").groupBy("db", "key").agg(F.max("offset").alias("last"))
    flushes = rows.filter("key IS NULL").groupBy(F.when(F.col("verb") == "FLUSHDB", F.col("db")).alias("scope")).agg(F.max("offset").alias("flushed"))
    seen = watched.withColumn("key", F.col("key").cast("binary")).join(touched.withColumn("key", F.col("key").cast("binary")), ["db", "key"], "left")
    dirty = seen.filter("last > seen").select("txn")
    # One row a database at most, and one for all of them.
    swept = watched.join(F.broadcast(flushes), F.col("scope").isNull() | (F.col("scope") == F.col("db"))).filter("flushed > seen").select("txn")
    return requests.join(dirty.unionByName(swept).distinct(), "txn", "left_anti")
