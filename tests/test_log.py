"""Folds against a plain model, recovery, effects and streams."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators.common import sample
from keyloom.plans import effects, fold, snapshot
from keyloom.streaming import jobs


def random_log(seed, n=400):
    r = random.Random(seed)
    b = lambda x: str(x).encode()
    out = []
    for i in range(n):
        kind = r.choice("SSHMZLX")
        k = f"{kind.lower()}{r.randint(0, 5)}".encode()
        f = [b(r.randint(0, 4)) for _ in range(2)]
        op = {
            "S": lambda: r.choice([("SET", k, b(r.randint(-5, 5))), ("INCRBY", k, b(r.randint(-3, 3))), ("SET", k, b"7", b"PXAT", b(10_000 + i))]),
            "H": lambda: r.choice([("HSET", k, f[0], b(i), f[1], b(i)), ("HDEL", k, *f)]),
            "M": lambda: r.choice([("SADD", k, *f), ("SADD", k, *f), ("SREM", k, *f)]),
            "Z": lambda: r.choice([("ZADD", k, b(r.random()), f[0]), ("ZREM", k, f[1]), ("ZADD", k, b"inf", f[0])]),
            "L": lambda: r.choice([("RPUSH", k, *f), ("LPUSH", k, *f), ("LPOP", k), ("LREM", k, b"0", f[0]), ("LTRIM", k, b"0", b"5"), ("LINSERT", k, b"AFTER", f[0], b"n")]),
            "X": lambda: r.choice([("DEL", k[:1].replace(b"x", b"s") + k[1:], b"m1"), ("MSET", b"s1", b(i), b"s2", b(i)), ("PEXPIREAT", b"m2", b(5000 + i)), ("PERSIST", b"h1"), ("APPEND", b"a", b(i)), ("FLUSHDB",) if r.random() < 0.05 else ("SADD", b"m0", b"q")]),
        }[kind]()
        out.append((i, op[0], list(op[1:])))
    return out


def model(log):
    """The same fold, one record at a time over a dictionary."""
    states = {}
    for _, verb, args in log:
        if verb == "FLUSHDB":
            states = {}
            continue
        todo = [("DEL", k, []) for k in args] if verb == "DEL" else [("SET", args[i], args[i + 1 : i + 2]) for i in range(0, len(args), 2)] if verb == "MSET" else [(verb, args[0], args[1:])]
        for v, k, a in todo:
            states.setdefault(k, fold.State()).apply(v, a)
    return {(k, s.kind, s.expire, *x) for k, s in states.items() if s.kind for x in s.rows()}


def frame(spark, log):
    return spark.createDataFrame([(o, 0, v, [bytearray(a) for a in args]) for o, v, args in log], "offset bigint, db int, verb string, args array<binary>")


def shown(elements):
    clean = lambda x: bytes(x) if isinstance(x, (bytes, bytearray)) else x
    return {tuple(clean(r[c]) for c in ("key", "type", "expire_at_ms", "pos", "field", "value", "score")) for r in elements.collect()}


@pytest.mark.parametrize("seed", [7, 20])
def test_fold_converges(spark, seed):
    log = random_log(seed)
    assert shown(fold.fold(frame(spark, log))) == model(log)


def test_recovery_equals_whole_fold(spark, tmp_path):
    log = [x for x in random_log(3, 200) if x[1] != "FLUSHDB"]
    df = frame(spark, log)
    anchors = spark.createDataFrame([(0, s, 60 + 10 * s) for s in range(4)], "db int, shard int, offset bigint")
    pre = fold.split_keys(df)
    keyed = snapshot.with_shard(pre, shards=4).join(anchors.withColumnRenamed("offset", "anchor"), ["db", "shard"]).filter("offset < anchor")
    before = keyed.select("offset", "db", "verb", F.concat(F.array("key"), "args").alias("args"))
    snapshot.save(fold.fold(before), anchors, str(tmp_path / "s"), 4)
    elements, kept = snapshot.load(spark, str(tmp_path / "s"))
    snapshot.check_gap(df, kept)
    assert shown(snapshot.recover(elements, df, kept, 4)) == model(log)
    with pytest.raises(ValueError):
        snapshot.check_gap(df.filter("offset > 100"), kept)
    segments = spark.createDataFrame([("a", 0, 50), ("b", 51, 300)], "segment string, first bigint, last bigint")
    assert [r.segment for r in snapshot.compact(segments, kept).collect()] == ["a"]
    assert snapshot.snapshot_due(4000, 0, 0, 0) and not snapshot.snapshot_due(10, 0, 100, 0)


def test_set_effects(spark):
    keys = spark.createDataFrame([(0, bytearray(b"old"), 0)], "db int, key binary, expire_at_ms bigint")
    r = [
        (1, b"old", True, False, False, None, "s", False),
        (2, b"new", True, False, False, 5, "s", False),
        (3, b"new", True, False, False, None, "s", False),
        (4, b"gone", False, True, False, None, "s", False),
        (5, b"new", False, True, True, None, "s", False),
        (6, b"old", False, False, False, 99, "ms", True),
    ]
    df = spark.createDataFrame([(o, 0, bytearray(k), bytearray(b"v"), nx, xx, kt, a, u, ab) for o, k, nx, xx, kt, a, u, ab in r], "offset bigint, db int, key binary, value binary, nx boolean, xx boolean, keepttl boolean, amount bigint, unit string, absolute boolean")
    got = {x.offset: [bytes(a) for a in x.args] for x in effects.set_effects(df, keys, 1000).collect()}
    assert got == {2: [b"new", b"v", b"PXAT", b"6000"], 5: [b"new", b"v", b"KEEPTTL"], 6: [b"old", b"v", b"PXAT", b"99"]}


def test_expire_and_store_effects(spark):
    keys = spark.createDataFrame([(0, bytearray(b"a"), 0), (0, bytearray(b"b"), 9000)], "db int, key binary, expire_at_ms bigint")
    asks = spark.createDataFrame([(1, 0, bytearray(b"a"), 3), (2, 0, bytearray(b"b"), 3)], "offset bigint, db int, key binary, amount bigint")
    got = {x.offset: (x.verb, [bytes(a) for a in x.args]) for x in effects.expire_effects(asks, keys, 1000, condition="gt").collect()}
    assert got == {}
    got = {x.offset: (x.verb, [bytes(a) for a in x.args]) for x in effects.expire_effects(asks, keys, 5000, absolute=True).collect()}
    assert got == {1: ("DEL", [b"a"]), 2: ("DEL", [b"b"])}
    el = spark.createDataFrame([(0, bytearray(b"x")), (1, bytearray(b"y"))], "pos bigint, value binary")
    log = effects.store_effects("list", b"dst", el, 50, expire_at_ms=77)
    state = shown(fold.fold(log))
    assert state == {(b"dst", "list", 77, 0, None, b"x", None), (b"dst", "list", 77, 1, None, b"y", None)}
    m = spark.createDataFrame([(0, bytearray(b"k"), bytearray(bytes([c]))) for c in b"abcd"], "db int, key binary, member binary")
    rem = effects.spop_effects(m, 2, "s", 9).collect()
    assert {bytes(r.args[1]) for r in rem} == {bytes(r.member) for r in sample(m, "member", 2, "s").collect()}


def test_transactions(spark):
    log = spark.createDataFrame([(10, 0, "SET", [bytearray(b"w"), bytearray(b"1")])], "offset bigint, db int, verb string, args array<binary>")
    asks = spark.createDataFrame([(1, 20), (2, 21)], "txn int, offset bigint")
    watched = spark.createDataFrame([(1, 0, bytearray(b"w"), 5), (2, 0, bytearray(b"w"), 10)], "txn int, db int, key binary, seen bigint")
    assert [r.txn for r in effects.transaction(asks, watched, log).collect()] == [2]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.range(20).select(F.col("id").alias("offset"), (F.col("id") % 3).cast("string").alias("key"), F.lit(1).cast("bigint").alias("delta")).write.parquet(src)
    stream = jobs.tail(spark, src, "offset bigint, key string, delta bigint")
    out = jobs.run_to_table(jobs.counters(stream, "key", "delta"), "counted", "complete")
    assert {r.key: r.value for r in out.collect()} == {"0": 7, "1": 7, "2": 6}
    last = jobs.run_to_table(jobs.last_writes(stream, "key", "delta", "offset"), "written", "complete")
    assert {r.key: r.version for r in last.collect()} == {"0": 18, "1": 19, "2": 17}
    jobs.follow(stream, str(tmp_path / "copy"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 20
    got = []
    subs = spark.createDataFrame([(1, "pattern", "[01]")], "client bigint, kind string, name string")
    jobs.publish(stream.withColumnRenamed("key", "channel"), subs, lambda df, _: got.append(df.count()), str(tmp_path / "c2")).awaitTermination()
    assert sum(got) == 14


def test_blocking_pops(spark, tmp_path):
    src = str(tmp_path / "q")
    data = [("q", 1, 0, "pop", 7, None, 0), ("q", 2, 0, "pop", 8, None, 100), ("q", 3, 50, "push", None, "a", 0), ("q", 4, 200, "push", None, "b", 0), ("q", 5, 201, "pop", 9, None, 0)]
    spark.createDataFrame(data, "queue string, seq bigint, at_ms bigint, kind string, client bigint, value string, deadline_ms bigint").coalesce(1).write.parquet(src)
    stream = jobs.tail(spark, src, "queue string, seq bigint, at_ms bigint, kind string, client bigint, value string, deadline_ms bigint")
    out = jobs.run_to_table(jobs.blocking_pops(stream), "pops", "append")
    assert sorted((r.client, r.value) for r in out.collect()) == [(7, "a"), (8, None), (9, "b")]


def test_expiry_timers(spark, tmp_path):
    src = str(tmp_path / "x")
    ddl = "key string, ts timestamp, expire_at_ms bigint"
    for k, rows in enumerate([[("a", 1, 5000), ("b", 1, 6000), ("c", 1, 4000)], [("b", 3, 90_000), ("c", 3, 0)], [("d", 30, 99_000)]]):
        df = spark.createDataFrame(rows, "key string, s int, expire_at_ms bigint")
        df.select("key", F.timestamp_seconds("s").alias("ts"), "expire_at_ms").coalesce(1).write.mode("append").parquet(src)
    out = jobs.run_to_table(jobs.expiry_timers(jobs.tail(spark, src, ddl, files=1)), "expiries", "append")
    assert [(r.key, r.expired_at_ms) for r in out.collect()] == [("a", 5000)]
