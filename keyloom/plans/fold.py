"""State as the fold of an effect log.

A log row is ``offset, db, verb, args``.  Keys whose log holds associative
verbs of one type only are folded in SQL (no Python, partial aggregation);
any other key is folded in order by one vectorised group a key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.patterns import ScoreRange
from ..functions.scalars import format_number, parse_float

#: Verbs whose every argument is a key.
MANY_KEYS = ("DEL", "UNLINK")
ASSOCIATIVE = {"string": ("SET", "INCRBY"), "hash": ("HSET", "HDEL"), "set": ("SADD", "SREM"), "zset": ("ZADD", "ZREM")}
REMOVALS = ("HDEL", "SREM", "ZREM")
OUT = "db int, key binary, type string, expire_at_ms bigint, pos bigint, field binary, value binary, score double"


def split_keys(log: DataFrame) -> DataFrame:
    """One row a key: DEL and UNLINK take keys, MSET pairs; the rest have the key first.

    FLUSHDB and FLUSHALL stay as they are, with a null key.  ``sub`` orders the
    rows of one offset: the log's own, where it has that column, then a
    record's parts.  One pass, no union.
    """
    verb, kind = F.upper(F.col("verb")), dict(log.dtypes)["args"]
    one = lambda v, key, args: F.struct(v.alias("verb"), key.alias("key"), args.alias("args"))
    none = F.array().cast(kind)
    starts = F.sequence(F.lit(0), F.greatest(F.size("args") - 2, F.lit(0)), F.lit(2))
    items = (
        F.when(verb.isin(*MANY_KEYS), F.transform("args", lambda k: one(F.lit("DEL"), k, none)))
        .when(verb == "MSET", F.transform(starts, lambda i: one(F.lit("SET"), F.get("args", i), F.slice("args", i + 2, F.lit(1)))))
        .when(verb.isin("FLUSHDB", "FLUSHALL"), F.array(one(verb, F.lit(None).cast("binary"), none)))
        .otherwise(F.array(one(verb, F.get("args", F.lit(0)), F.slice("args", F.lit(2), F.greatest(F.size("args") - 1, F.lit(0))))))
    )
    own = F.col("sub").cast("bigint") if "sub" in log.columns else F.lit(0).cast("bigint")
    parts = log.select("offset", "db", own.alias("own"), F.posexplode(items).alias("part", "x"))
    sub = F.shiftleft("own", 24) + F.col("part")
    return parts.select("offset", "db", "x.verb", sub.alias("sub"), "x.key", "x.args")


def _keeps() -> Column:
    return F.exists("args", lambda a: F.upper(a.cast("string")) == "KEEPTTL")


def after_flushes(rows: DataFrame) -> DataFrame:
    """Keyed rows after the last flush of their database."""
    one = F.when(F.col("verb") == "FLUSHDB", F.col("db"))
    # One row a database and one for all of them: a fixed bound.
    found = {r.scope: r.at for r in rows.filter("key is null").groupBy(one.alias("scope")).agg(F.max("offset").alias("at")).collect()}
    data = rows.filter("key is not null")
    if not found:
        return data
    every = found.pop(None, None)
    floor = F.lit(-(1 << 63) if every is None else every)
    for db, at in found.items():
        floor = F.when(F.col("db") == db, F.greatest(floor, F.lit(at))).otherwise(floor)
    return data.filter(F.col("offset") > floor)


def routed(rows: DataFrame) -> DataFrame:
    """Rows after their key's barrier, with its ``route``: ``sql`` or ``ordered``.

    The barrier is the last DEL (dropped) or plain SET (kept).  SQL folds keys
    whose later verbs are associative and of one type.  A key with removals and
    an expiry is ordered, since emptying it in between would drop the expiry;
    so is one with a SET that keeps the expiry, which is no barrier.
    """
    place = F.struct("offset", "sub")
    data = after_flushes(rows).withColumn("kept", (F.col("verb") == "SET") & _keeps())
    name = F.when(F.col("kept"), "SET KEEPTTL").otherwise(F.col("verb"))
    # One entry a verb: bounded, whatever the length of the key's log.
    verbs = data.groupBy("db", "key", name.alias("name")).agg(F.max(place).alias("last"))
    keys = verbs.groupBy("db", "key").agg(
        F.max(F.when(F.col("name") == "DEL", F.col("last"))).alias("dead"),
        F.max(F.when(F.col("name") == "SET", F.col("last"))).alias("fresh"),
        F.collect_list(F.struct("name", "last")).alias("verbs"),
    )
    after = F.filter("verbs", lambda v: (F.col("dead").isNull() | (v["last"] > F.col("dead"))) & (F.col("fresh").isNull() | (v["last"] >= F.col("fresh"))))
    keys = keys.withColumn("names", F.transform(after, lambda v: v["name"]))
    extra = _names("PEXPIREAT", "PERSIST")
    sql = F.lit(False)
    for allowed in ASSOCIATIVE.values():
        only = F.size(F.array_except("names", F.concat(_names(*allowed), extra))) == 0
        sql = sql | (only & F.arrays_overlap("names", _names(*allowed)))
    sql = sql & ~(F.arrays_overlap("names", _names(*REMOVALS)) & F.arrays_overlap("names", extra))
    keys = keys.select("db", "key", "dead", "fresh", F.when(sql, "sql").otherwise("ordered").alias("route"))
    out = data.join(keys, ["db", "key"])
    out = out.filter((F.col("dead").isNull() | (place > F.col("dead"))) & (F.col("fresh").isNull() | (place >= F.col("fresh"))))
    return out.select("offset", "db", "verb", "sub", "key", "args", "route")


def _names(*verbs: str) -> Column:
    return F.array(*map(F.lit, verbs))


def fold_associative(rows: DataFrame) -> DataFrame:
    """All keys of associative verbs in one aggregation: ``db, key, type, field, value, score``.

    Every element keeps its last operation; an element whose last operation
    removed it is gone.  A string is its barrier SET plus the increments after
    it.  Partial aggregation runs before the one shuffle, so hot keys are cheap.
    """
    binary = F.lit(None).cast("binary")
    element = lambda kind, live, field, value, score, incr: F.struct(F.lit(kind).alias("type"), F.lit(live).alias("live"), field.cast("binary").alias("field"), value.cast("binary").alias("value"), score.cast("double").alias("score"), incr.cast("bigint").alias("incr"))
    nothing = F.lit(None)
    halves = F.transform(F.sequence(F.lit(0), F.greatest(F.size("args") - 2, F.lit(0)), F.lit(2)), lambda i: F.slice("args", i + 1, F.lit(2)))
    each = lambda kind, live: F.transform("args", lambda m: element(kind, live, m, binary, nothing, nothing))
    verb = F.col("verb")
    items = (
        F.when(verb == "SET", F.array(element("string", True, binary, F.try_element_at("args", F.lit(1)), nothing, nothing)))
        .when(verb == "INCRBY", F.array(element("string", True, binary, binary, nothing, F.try_element_at("args", F.lit(1)).cast("string").try_cast("bigint"))))
        .when(verb == "HSET", F.transform(halves, lambda p: element("hash", True, p[0], p[1], nothing, nothing)))
        .when(verb == "ZADD", F.transform(halves, lambda p: element("zset", True, p[1], binary, parse_float(p[0]), nothing)))
        .when(verb == "HDEL", each("hash", False))
        .when(verb == "SADD", each("set", True))
        .when(verb == "SREM", each("set", False))
        .when(verb == "ZREM", each("zset", False))
    )
    flat = rows.filter(verb.isin(*[v for verbs in ASSOCIATIVE.values() for v in verbs])).select("db", "key", "offset", "sub", F.posexplode(items).alias("k", "x"))
    last = F.max_by(F.struct("x.live", "x.value", "x.score"), F.when(F.col("x.incr").isNull(), F.struct("offset", "sub", "k")))
    out = flat.groupBy("db", "key", F.col("x.type").alias("type"), F.col("x.field").alias("field")).agg(last.alias("y"), F.sum("x.incr").alias("add"))
    total = (F.coalesce(F.col("y.value").cast("string").cast("bigint"), F.lit(0)) + F.col("add")).cast("string").cast("binary")
    out = out.filter("add is not null or y.live")
    return out.select("db", "key", "type", "field", F.when(F.col("add").isNull(), F.col("y.value")).otherwise(total).alias("value"), "y.score")


class State:
    """The value of one key under ordered effects."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.kind: str | None = None
        self.value = None
        self.expire = 0

    def need(self, kind: str, fresh):
        if self.kind is None:
            self.kind, self.value = kind, fresh()
        elif self.kind != kind:
            raise ValueError("WRONGTYPE in log")
        return self.value

    def settle(self) -> None:
        if self.kind not in (None, "string") and not self.value:
            self.clear()

    def apply(self, verb: str, args: list[bytes]) -> None:
        done = getattr(self, "do_" + verb.lower(), None)
        if done is None:
            raise ValueError(f"{verb} is not a record of one key: it is resolved when written (plans.effects)")
        done(*args)
        self.settle()

    def do_del(self):
        self.clear()

    def do_set(self, value, *options):
        names = [o.upper() for o in options]
        at = int(options[names.index(b"PXAT") + 1]) if b"PXAT" in names else self.expire if b"KEEPTTL" in names else 0
        self.kind, self.value, self.expire = "string", value, at

    def do_pexpireat(self, at, *_):
        if self.kind:
            self.expire = int(at)

    def do_persist(self):
        self.expire = 0

    def do_append(self, value):
        self.value = self.need("string", bytes) + value

    def do_setrange(self, offset, value):
        old = self.need("string", bytes)
        at = int(offset)
        if value:
            self.value = old[:at].ljust(at, b"\0") + value + old[at + len(value) :]

    def do_incrby(self, n):
        self.value = str(int(self.need("string", lambda: b"0")) + int(n)).encode()

    def do_incr(self):
        self.do_incrby(b"1")

    def do_decr(self):
        self.do_incrby(b"-1")

    def do_decrby(self, n):
        self.do_incrby(str(-int(n)).encode())

    def do_incrbyfloat(self, x):
        self.value = format_number(float(self.need("string", lambda: b"0")) + float(x)).encode()

    def do_hset(self, *pairs):
        self.need("hash", dict).update(zip(pairs[::2], pairs[1::2]))

    do_hmset = do_hset

    def do_hdel(self, *fields):
        for f in fields:
            self.need("hash", dict).pop(f, None)

    def do_hincrby(self, field, n):
        h = self.need("hash", dict)
        h[field] = str(int(h.get(field, b"0")) + int(n)).encode()

    def do_sadd(self, *members):
        self.need("set", dict).update(dict.fromkeys(members))

    def do_srem(self, *members):
        for m in members:
            self.need("set", dict).pop(m, None)

    def do_zadd(self, *pairs):
        self.need("zset", dict).update((m, float(s)) for s, m in zip(pairs[::2], pairs[1::2]))

    def do_zrem(self, *members):
        for m in members:
            self.need("zset", dict).pop(m, None)

    def _ranked(self):
        return [m for _, m in sorted((s, m) for m, s in self.need("zset", dict).items())]

    def _pop(self, n, rev):
        for m in self._ranked()[::-1 if rev else 1][: int(n)]:
            del self.value[m]

    def do_zpopmin(self, n=b"1"):
        self._pop(n, False)

    def do_zpopmax(self, n=b"1"):
        self._pop(n, True)

    def _drop(self, gone):
        for m in gone:
            del self.value[m]

    def do_zremrangebyrank(self, start, stop):
        ranked = self._ranked()
        a, b, n = int(start), int(stop), len(ranked)
        self._drop(ranked[max(a + n if a < 0 else a, 0) : max((b + n if b < 0 else b) + 1, 0)])

    def do_zremrangebyscore(self, lo, hi):
        r = ScoreRange.parse(lo.decode(), hi.decode())
        inside = lambda s: (s > r.lo if r.lo_open else s >= r.lo) and (s < r.hi if r.hi_open else s <= r.hi)
        self._drop([m for m, s in self.need("zset", dict).items() if inside(s)])

    def do_zremrangebylex(self, lo, hi):
        def above(m, end):
            return end == b"-" or end != b"+" and (m > end[1:] if end[:1] == b"(" else m >= end[1:])

        def below(m, end):
            return end == b"+" or end != b"-" and (m < end[1:] if end[:1] == b"(" else m <= end[1:])

        self._drop([m for m in self.need("zset", dict) if above(m, lo) and below(m, hi)])

    def do_rpush(self, *values):
        self.need("list", list).extend(values)

    def do_lpush(self, *values):
        self.need("list", list)[:0] = values[::-1]

    def do_rpushx(self, *values):
        if self.kind:
            self.do_rpush(*values)

    def do_lpushx(self, *values):
        if self.kind:
            self.do_lpush(*values)

    def do_lpop(self, n=b"1"):
        del self.need("list", list)[: int(n)]

    def do_rpop(self, n=b"1"):
        l = self.need("list", list)
        del l[max(0, len(l) - int(n)) :]

    def do_lset(self, i, value):
        self.need("list", list)[int(i)] = value

    def do_ltrim(self, start, stop):
        l = self.need("list", list)
        a, b, n = int(start), int(stop), len(l)
        a, b = max(a + n if a < 0 else a, 0), min(b + n if b < 0 else b, n - 1)
        self.value = l[a : b + 1] if a <= b else []

    def do_lrem(self, n, value):
        l, n = self.need("list", list), int(n)
        at = [i for i, v in enumerate(l) if v == value]
        drop = set(at[:n] if n > 0 else at[n:] if n < 0 else at)
        self.value = [v for i, v in enumerate(l) if i not in drop]

    def do_linsert(self, where, pivot, value):
        l = self.need("list", list)
        if pivot in l:
            l.insert(l.index(pivot) + (where.upper() == b"AFTER"), value)

    def rows(self):
        """``pos, field, value, score`` of the key's elements."""
        if self.kind == "string":
            yield None, None, self.value, None
        elif self.kind == "list":
            yield from ((i, None, v, None) for i, v in enumerate(self.value))
        elif self.kind == "hash":
            yield from ((None, f, v, None) for f, v in self.value.items())
        elif self.kind == "set":
            yield from ((None, m, None, None) for m in self.value)
        elif self.kind == "zset":
            yield from ((None, m, None, s) for m, s in self.value.items())


def fold_group(rows: pd.DataFrame) -> pd.DataFrame:
    """Ordered fold of one key."""
    rows = rows.sort_values(["offset", "sub"])
    state = State()
    for verb, args in zip(rows["verb"], rows["args"]):
        state.apply(verb, [bytes(a) for a in args])
    db, key = int(rows["db"].iloc[0]), bytes(rows["key"].iloc[0])
    out = [(db, key, state.kind, state.expire, *r) for r in state.rows()]
    return pd.DataFrame(out, columns=["db", "key", "type", "expire_at_ms", "pos", "field", "value", "score"]).astype({"pos": "Int64", "score": "float64"})


def fold_ordered(rows: DataFrame) -> DataFrame:
    """Ordered fold of every key: elements with type and expiry.  A key's log is one group."""
    return rows.groupBy("db", "key").applyInPandas(fold_group, OUT)


def fold(log: DataFrame) -> DataFrame:
    """All elements of the keyspace after a log, in the common element schema ``OUT``."""
    return fold_split(split_keys(log))


def fold_split(rows: DataFrame) -> DataFrame:
    """The same for rows that are split by key already."""
    rows = routed(rows)
    easy = rows.filter("route <> 'ordered'")
    sql = fold_associative(easy).join(expiries(easy), ["db", "key"], "left")
    sql = sql.withColumn("expire_at_ms", F.coalesce("expire_at_ms", F.lit(0))).withColumn("pos", F.lit(None).cast("bigint"))
    ordered = fold_ordered(rows.filter("route = 'ordered'").drop("route"))
    return ordered.unionByName(sql.select(*ordered.columns))


def expiries(rows: DataFrame) -> DataFrame:
    """The expiry that stands at the end: the last of PEXPIREAT, PERSIST, and SET with or without one."""
    options = F.transform("args", lambda a: F.upper(a.cast("string")))
    place = F.struct("offset", "sub")
    pxat = F.array_position(options, "PXAT").cast("int")
    at = (
        F.when(F.col("verb") == "PEXPIREAT", F.col("args")[0].cast("string").cast("bigint"))
        .when(F.col("verb") == "PERSIST", F.lit(0).cast("bigint"))
        .when((F.col("verb") == "SET") & (pxat > 0), F.try_element_at("args", pxat + 1).cast("string").cast("bigint"))
        .when((F.col("verb") == "SET") & ~F.array_contains(options, "KEEPTTL"), F.lit(0).cast("bigint"))
    )
    return rows.withColumn("at", at).filter("at is not null").groupBy("db", "key").agg(F.max_by("at", place).alias("expire_at_ms"))


def tables(elements: DataFrame) -> dict[str, DataFrame]:
    """The normal-form tables of folded elements."""
    of = lambda kind: elements.filter(F.col("type") == kind)
    return {
        "K": elements.groupBy("db", "key").agg(F.first("type").alias("type"), F.max("expire_at_ms").alias("expire_at_ms")),
        "S": of("string").select("db", "key", "value"),
        "L": of("list").select("db", "key", "pos", "value"),
        "H": of("hash").select("db", "key", "field", "value"),
        "M": of("set").select("db", "key", F.col("field").alias("member")),
        "Z": of("zset").select("db", "key", F.col("field").alias("member"), "score"),
    }
