"""Golden and model tests of the multi-key operators on small tables."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from keyloom.operators import eviction, generic, hashes, introspection, lists, live, pubsub, sets, sorting, strings, zsets
from keyloom.plans import registry


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def z(spark):
    data = [("a", "x", 1.0), ("a", "y", 1.0), ("a", "w", -math.inf), ("a", "v", math.inf), ("a", "u", 2.5), ("b", "x", 5.0)]
    return spark.createDataFrame(data, "key string, member string, score double").cache()


@pytest.fixture(scope="module")
def l(spark):
    return spark.createDataFrame([("a", i * 10, v) for i, v in enumerate("abcabca")] + [("b", 5, "z")], "key string, pos bigint, value string").cache()


def order(df):
    return [r.member for r in df.filter("key = 'a'").orderBy("idx").collect()]


def test_zrange(z):
    assert order(zsets.zrange(z, 0, -1)) == ["w", "x", "y", "u", "v"]
    assert order(zsets.zrange(z, 0, 1, rev=True)) == ["v", "u"]
    assert order(zsets.zrange(z, -2, -1)) == ["u", "v"]
    assert order(zsets.zrange(z, 3, 1)) == []
    assert order(zsets.zrange(z, -100, 0)) == ["w"]


@pytest.mark.parametrize("seed", range(3))
def test_zrange_model(spark, seed):
    r = random.Random(seed)
    data = [("k", f"m{i}", r.choice([0.0, 1.0, -1.0, 2.5, 100.0, math.inf])) for i in range(12)]
    df = spark.createDataFrame(data, "key string, member string, score double")
    want = [m for _, m in sorted((s, m) for _, m, s in data)]
    for _ in range(4):
        a, b = r.randint(-14, 14), r.randint(-14, 14)
        n = len(want)
        lo, hi = max(a + n if a < 0 else a, 0), min(b + n if b < 0 else b, n - 1)
        got = [x.member for x in zsets.zrange(df, a, b).orderBy("idx").collect()]
        assert got == (want[lo : hi + 1] if lo <= hi else [])


def test_score_and_lex_ranges(z):
    assert rows(zsets.zcount(z, "(1", "+inf"), "key", "n") == [("a", 2), ("b", 1)]
    assert rows(zsets.zcount(z, "-inf", "(1"), "key", "n") == [("a", 1), ("b", 0)]
    assert [r.member for r in zsets.zrangebyscore(z.filter("key = 'a'"), "-inf", "inf", offset=1, limit=2).orderBy("score", "member").collect()] == ["x", "y"]
    assert zsets.zrangebyscore(z, 0, 9, offset=-1).count() == 0
    assert rows(zsets.zlexcount(z, "[u", "(x"), "key", "n") == [("a", 3), ("b", 0)]
    assert rows(zsets.zremrangebyscore(z, 1, "inf"), "member") == [("w",)]


def test_zadd_options(spark, z):
    adds = spark.createDataFrame([("a", "x", 0.5, 1), ("a", "x", 3.0, 2), ("c", "n", 1.0, 3)], "key string, member string, score double, seq int")
    pick = lambda t: {(r.key, r.member): r.score for r in t.collect() if r.member in "xn" and r.key != "b"}
    assert pick(zsets.zadd(z, adds)[0]) == {("a", "x"): 3.0, ("c", "n"): 1.0}
    assert pick(zsets.zadd(z, adds, nx=True)[0]) == {("a", "x"): 1.0, ("c", "n"): 1.0}
    assert pick(zsets.zadd(z, adds, xx=True)[0]) == {("a", "x"): 3.0}
    assert pick(zsets.zadd(z, adds, lt=True)[0]) == {("a", "x"): 0.5, ("c", "n"): 1.0}
    assert pick(zsets.zadd(z, adds, incr=True)[0]) == {("a", "x"): 4.5, ("c", "n"): 1.0}
    assert rows(zsets.zadd(z, adds)[1], "key", "added", "changed") == [("a", 0, 1), ("c", 1, 0)]
    with pytest.raises(ValueError):
        zsets.zadd(z, adds, nx=True, gt=True)


def test_weighted_sets(spark):
    f = lambda *x: spark.createDataFrame(list(x), "member string, score double")
    a, b, c = f(("m", math.inf), ("n", 1.0)), f(("m", -math.inf), ("n", 2.0)), f(("m", 5.0))
    assert rows(zsets.zunion(a, b, c), "member", "score") == [("m", 5.0), ("n", 3.0)]
    assert rows(zsets.zunion(a, b), "member", "score") == [("m", 0.0), ("n", 3.0)]
    assert rows(zsets.zunion(a, weights=[0]), "member", "score") == [("m", 0.0), ("n", 0.0)]
    assert rows(zsets.zinter(a, b, aggregate="max"), "member", "score") == [("m", math.inf), ("n", 2.0)]
    plain = spark.createDataFrame([("n",)], "member string")
    assert rows(zsets.zinter(a, plain), "member", "score") == [("n", 2.0)]
    assert rows(zsets.zdiff(a, plain), "member", "score") == [("m", math.inf)]


def test_sets(spark):
    m = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3)], "key string, member int")
    assert rows(sets.sinter_keys(m, ["a", "b"]), "member") == [(2,)]
    assert rows(sets.sinter_keys(m, ["a", "missing"]), "member") == []
    assert rows(sets.smove(m, "a", "b", 1), "key", "member") == [("a", 2), ("b", 1), ("b", 2), ("b", 3)]
    assert rows(sets.smove(m, "a", "a", 1), "key", "member") == rows(m, "key", "member")
    assert rows(sets.smove(m, "a", "b", 9), "key", "member") == rows(m, "key", "member")
    new, added = sets.sadd(m, spark.createDataFrame([("a", 2), ("a", 5), ("a", 5)], "key string, member int"))
    assert rows(added, "key", "added") == [("a", 1)] and new.count() == 5
    chosen, left = sets.spop(m, 1, seed=3)
    assert chosen.count() == 2 and left.count() == 2
    assert sets.srandmember(m, -5, seed=1).count() == 10
    assert rows(sets.sstore(m, "a", sets.sdiff(sets.members(m, "a"), sets.members(m, "b"))).filter("key = 'a'"), "member") == [(1,)]
    pages = [sets.sscan(m, c, 3) for c in range(3)]
    assert sum(p.count() for p in pages) == 4


def test_lists(spark, l):
    vals = lambda df, by="pos": "".join(r.value for r in df.filter("key = 'a'").orderBy(by).collect())
    assert vals(lists.lrange(l, -10, -6)) == "ab"
    assert vals(lists.lrange(l, -3, -1)) == "bca" and vals(lists.lrange(l, 5, 1)) == ""
    assert vals(lists.ltrim(l, 1, -2)) == "bcabc"
    assert rows(lists.lindex(l, -1), "key", "value") == [("a", "a"), ("b", "z")]
    assert vals(lists.lrem(l, -2, "a")) == "abcbc" and vals(lists.lrem(l, 0, "a")) == "bcbc" and vals(lists.lrem(l, 1, "a")) == "bcabca"
    assert vals(lists.linsert(l, "b", "X")) == "aXbcabca" and vals(lists.linsert(l, "?", "X")) == "abcabca"
    at = lambda **k: [r.idx for r in lists.lpos(l, "a", **k).filter("key = 'a'").orderBy("occurrence").collect()]
    assert at() == [0] and at(rank=2) == [3] and at(rank=-1) == [6] and at(n=0) == [0, 3, 6] and at(rank=-1, maxlen=4) == [3] and at(rank=9) == []
    with pytest.raises(ValueError):
        lists.lpos(l, "a", rank=0)
    assert vals(lists.lmove(l, "a", "a")) == "aabcabc"
    moved = lists.lmove(l, "a", "b", "left", "right")
    assert vals(moved) == "bcabca" and rows(moved.filter("key = 'b'"), "value") == [("a",), ("z",)]
    new = spark.createDataFrame([("a", 1, "P"), ("a", 2, "Q"), ("n", 3, "R")], "key string, seq int, value string")
    assert vals(lists.push(l, new, "left")[0]) == "QPabcabca" and vals(lists.push(l, new)[0]) == "abcabcaPQ"
    assert lists.push(l, new, existing_only=True)[0].filter("key = 'n'").count() == 0
    popped, left = lists.pop(l, 2, "right")
    assert vals(popped, "idx") == "ac" and vals(left) == "abcab"
    with pytest.raises(PySparkException):
        lists.lset(l, 3, "v").collect()
    assert vals(lists.lset(l, -1, "v")) == "abcabcv"


def test_sort(spark):
    t = spark.createDataFrame([("k", str(v)) for v in (10, 9, 2, 1, 33)], "key string, value string")
    take = lambda **k: [r.value for r in sorting.sort(t, **k).orderBy("idx").collect()]
    assert take() == ["1", "2", "9", "10", "33"] and take(alpha=True, desc=True) == ["9", "33", "2", "10", "1"] and take(offset=1, limit=2) == ["2", "9"]
    with pytest.raises(PySparkException):
        sorting.sort(t.withColumn("value", F.lit("x"))).collect()


def test_strings(spark):
    s = spark.createDataFrame([("a", "5"), ("t", "x")], "key string, value string")
    d = spark.createDataFrame([("a", 2), ("n", 7)], "key string, delta bigint")
    assert rows(strings.incrby(s, d), "key", "value") == [("a", "7"), ("n", "7"), ("t", "x")]
    for key, delta in (("t", 1), ("a", (1 << 63) - 1)):
        with pytest.raises(PySparkException):
            strings.incrby(s, spark.createDataFrame([(key, delta)], "key string, delta bigint")).collect()
    fl = spark.createDataFrame([("a", 1, 0.1), ("a", 2, 0.2), ("n", 3, 3.0)], "key string, seq int, delta double")
    assert rows(strings.incrbyfloat(s, fl), "key", "value") == [("a", "5.3"), ("n", "3"), ("t", "x")]
    b = spark.createDataFrame([(bytearray(b"hello"),), (None,)], "v binary")
    assert [bytes(r[0]) for r in b.select(strings.setrange(F.col("v"), 7, b"XY")).collect()] == [b"hello\0\0XY", b"\0" * 7 + b"XY"]
    assert [bytes(r[0]) for r in b.limit(1).select(strings.setrange(F.col("v"), 1, b"XY")).collect()] == [b"hXYlo"]
    w = spark.createDataFrame([("a", 1, "1"), ("z", 1, "1"), ("z", 2, "2")], "key string, seq int, value string")
    assert rows(strings.put(s, w), "key", "value") == [("a", "1"), ("t", "x"), ("z", "2")]
    assert rows(strings.put(s, w, nx=True), "key", "value") == [("a", "5"), ("t", "x"), ("z", "1")]
    assert rows(strings.put(s, w, xx=True), "key", "value") == [("a", "1"), ("t", "x")]
    assert rows(strings.msetnx(s, w, s), "key", "value") == rows(s, "key", "value")
    assert strings.msetnx(s, w.filter("key = 'z'"), s).count() == 3


def test_hashes(spark):
    h = spark.createDataFrame([("k", "f", "1"), ("k", "g", "x")], "key string, field string, value string")
    d = spark.createDataFrame([("k", "f", 4)], "key string, field string, delta bigint")
    assert rows(hashes.hincrby(h, d), "field", "value") == [("f", "5"), ("g", "x")]
    with pytest.raises(PySparkException):
        hashes.hincrby(h, d.withColumn("field", F.lit("g"))).collect()
    new = spark.createDataFrame([("k", "f", "2", 1), ("k", "n", "3", 2), ("k", "n", "4", 3)], "key string, field string, value string, seq int")
    table, added = hashes.hset(h, new)
    assert rows(table, "field", "value") == [("f", "2"), ("g", "x"), ("n", "4")] and rows(added, "added") == [(1,)]
    assert rows(hashes.hsetnx(h, new), "field", "value") == [("f", "1"), ("g", "x"), ("n", "3")]
    f = spark.createDataFrame([("k", "f", 1, 0.5)], "key string, field string, seq int, delta double")
    assert rows(hashes.hincrbyfloat(h, f), "field", "value") == [("f", "1.5"), ("g", "x")]
    assert hashes.hexists(h, spark.createDataFrame([("k", "f"), ("k", "q")], "key string, field string")).agg(F.sum("found")).first()[0] == 1


def test_expiry(spark):
    k = spark.createDataFrame([("a", 0), ("b", 1000), ("c", 5000)], "key string, expire_at_ms bigint")
    assert rows(live.live(k, 1000), "key") == [("a",), ("c",)]
    assert rows(live.live(k, 1000, live.LOADING), "key") == [("a",), ("b",), ("c",)]
    got = rows(k.select("key", generic.ttl(F.col("expire_at_ms"), 1000).alias("t"), generic.ttl(F.col("expire_at_ms"), 999, "ms").alias("p"), generic.expiretime(F.col("expire_at_ms"), 0).alias("e")), "key", "t", "p", "e")
    assert got == [("a", -1, -1, -1), ("b", -2, 1, 1), ("c", 4, 4001, 5)]
    assert k.limit(1).select(generic.ttl(F.lit(1001).cast("bigint"), 0)).first()[0] == 2
    r = spark.createDataFrame([("a", 3), ("c", 3)], "key string, amount bigint")
    at = lambda **o: {x.key: x.expire_at_ms for x in generic.expire(k, r, 1000, **o).collect()}
    assert at() == {"a": 4000, "c": 4000}
    assert at(condition="gt") == {"a": 0, "c": 5000} and at(condition="lt") == {"a": 4000, "c": 4000}
    assert at(condition="nx") == {"a": 4000, "c": 5000} and at(condition="xx") == {"a": 0, "c": 4000}
    assert at(absolute=True, unit="ms") == {}
    with pytest.raises(PySparkException):
        generic.expire(k, r.withColumn("amount", F.lit(0)), 1000).collect()
    assert rows(eviction.sweep(k, 5000), "key") == [("b",), ("c",)]


def test_keys(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    assert rows(generic.rename(t, "a", "b"), "key", "value") == [("b", 1)]
    assert rows(generic.rename(t, "a", "a"), "key", "value") == [("a", 1), ("b", 2)]
    assert rows(generic.copy(t, "a", "b"), "key", "value") == [("a", 1), ("b", 1)]
    with pytest.raises(ValueError):
        generic.copy(t, "a", "a")
    assert not generic.renamenx_allowed(t, "a", "a") and generic.renamenx_allowed(t, "a", "n")
    with pytest.raises(KeyError):
        generic.renamenx_allowed(t, "q", "n")
    swap = spark.createDataFrame([("a", "b"), ("b", "a")], "key string, new_key string")
    assert rows(generic.move_mapping(t, swap), "key", "value") == [("a", 2), ("b", 1)]
    asked = spark.createDataFrame([("a",), ("a",), ("q",)], "key string")
    assert generic.exists(t, asked).first().n == 2
    k = t.withColumn("type", F.lit("string"))
    assert rows(generic.type_of(k, asked.distinct()), "key", "type") == [("a", "string"), ("q", "none")]


def test_eviction_model(spark):
    r = random.Random(1)
    data = [(f"k{i}", r.randint(1, 50), r.randint(0, 9), r.choice([0, 100 + i]), i % 3) for i in range(60)]
    k = spark.createDataFrame(data, "key string, bytes bigint, last_access_ms bigint, expire_at_ms bigint, freq int")
    total = sum(d[1] for d in data)
    for policy, rank, pool in (("allkeys-lru", 2, data), ("volatile-ttl", 3, [d for d in data if d[3]]), ("allkeys-lfu", 4, data)):
        want, left = set(), total
        for d in sorted(pool, key=lambda d: (d[rank], d[0])):
            if left < 700:
                break
            want.add(d[0])
            left -= d[1]
        assert {x.key for x in eviction.evict(k, 700, policy).collect()} == want
    assert eviction.evict(k, total + 1).count() == 0 and eviction.evict(k, 1, "noeviction").count() == 0


def test_pubsub(spark):
    subs = spark.createDataFrame([(1, "channel", "news"), (1, "pattern", "n*"), (2, "pattern", "*")], "client bigint, kind string, name string")
    msgs = spark.createDataFrame([(1, "news"), (2, "other"), (3, "n")], "msg_id bigint, channel string")
    assert rows(pubsub.publish_counts(msgs, subs), "msg_id", "receivers") == [(1, 3), (2, 1), (3, 2)]
    assert pubsub.numpat(subs).first().n == 2
    assert pubsub.publish_counts(msgs, pubsub.unsubscribe(subs, 2, "pattern")).filter("msg_id = 2").first().receivers == 0


def test_encodings(spark):
    m = spark.createDataFrame([("i", str(i)) for i in range(600)] + [("s", "a"), ("n", "7")], "key string, member string")
    got = introspection.collection_encoding(introspection.collection_stats(m, "member"), "set")
    assert rows(got, "key", "encoding") == [("i", "hashtable"), ("n", "intset"), ("s", "listpack")]


def test_registry_is_complete():
    assert len(registry.COMMANDS) == 173 and len(registry.REFUSED) == 27
    for c in registry.COMMANDS.values():
        assert c.effect in (registry.NONE, registry.VERBATIM, registry.CANONICAL)
        if c.in_scope:
            assert callable(c.function()), c
    with pytest.raises(NotImplementedError):
        registry.lookup("eval")
    with pytest.raises(KeyError):
        registry.lookup("nope")
