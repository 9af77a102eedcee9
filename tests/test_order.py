"""What the log and the writes do with several records of one key, offset or database."""

import pytest
from pyspark.sql import functions as F

from keyloom.operators import generic, pubsub, zsets
from keyloom.plans import effects, fold, snapshot

from test_log import frame, model, random_log, shown

LOG = "offset bigint, db int, verb string, args array<binary>"


def records(spark, rows):
    return spark.createDataFrame([(o, d, v, [bytearray(a) for a in args]) for o, d, v, *args in rows], LOG)


def lists(elements):
    found = {}
    for r in sorted(elements.filter("type = 'list'").collect(), key=lambda r: r.pos):
        found.setdefault(bytes(r.key), []).append(bytes(r.value))
    return found


def test_what_is_logged_after_a_store_comes_after_it(spark):
    el = spark.createDataFrame([(k, bytearray(str(k).encode())) for k in range(5)], "pos bigint, value binary")
    log = effects.store_effects("list", b"dst", el, 50, expire_at_ms=77)
    assert {r.offset for r in log.collect()} == {50}
    later = records(spark, [(51, 0, "RPUSH", b"dst", b"later"), (49, 0, "RPUSH", b"dst", b"earlier")]).withColumn("sub", F.lit(0).cast("bigint"))
    assert lists(fold.fold(log.unionByName(later))) == {b"dst": [b"0", b"1", b"2", b"3", b"4", b"later"]}
    assert effects.store_effects("list", b"dst", el.limit(0), 50, expire_at_ms=77).count() == 1


def test_a_watch_sees_every_key_of_a_record_and_flushes(spark):
    asks = spark.createDataFrame([(t, 100 + t) for t in range(1, 7)], "txn int, offset bigint")
    seen = [(1, 0, b"b"), (2, 0, b"d"), (3, 1, b"x"), (4, 2, b"x"), (5, 0, b"none"), (6, 0, b"a")]
    watched = spark.createDataFrame([(t, d, bytearray(k), 5) for t, d, k in seen], "txn int, db int, key binary, seen bigint")
    log = records(spark, [(10, 0, "DEL", b"a", b"b"), (11, 0, "MSET", b"c", b"1", b"d", b"2"), (12, 1, "FLUSHDB")])
    left = lambda log: sorted(r.txn for r in effects.transaction(asks, watched, log).collect())
    assert left(log) == [4, 5]
    assert left(log.unionByName(records(spark, [(13, 0, "FLUSHALL")]))) == []
    assert left(records(spark, [(4, 0, "FLUSHALL"), (5, 0, "SET", b"a", b"1")])) == [1, 2, 3, 4, 5, 6]


def saved(spark, path, log, offsets):
    df = frame(spark, log)
    anchors = spark.createDataFrame([(0, s, o) for s, o in enumerate(offsets)], "db int, shard int, offset bigint")
    keyed = snapshot.with_shard(fold.split_keys(df).filter("key is not null"), shards=4).join(anchors.withColumnRenamed("offset", "anchor"), ["db", "shard"]).filter("offset < anchor")
    snapshot.save(fold.fold_split(keyed.select("offset", "db", "verb", "sub", "key", "args")), anchors, path, 4)
    return df, *snapshot.load(spark, path)


def test_recovery_with_a_flush(spark, tmp_path):
    log = [x for x in random_log(3, 200) if x[1] != "FLUSHDB"]
    log = [x for x in log if x[0] < 120] + [(120, "FLUSHDB", [])] + [x for x in log if x[0] > 120]
    if len(log[0]) != len(log[-1]) or len(log[0]) != 3:
        pytest.skip("another shape of log")
    df, elements, anchors = saved(spark, str(tmp_path / "before"), log, (60, 70, 80, 90))
    snapshot.check_gap(df, anchors)
    assert shown(snapshot.recover(elements, df, anchors, 4)) == model(log)
    df, elements, anchors = saved(spark, str(tmp_path / "across"), log, (60, 70, 130, 140))
    for refused in (lambda: snapshot.check_gap(df, anchors), lambda: snapshot.recover(elements, df, anchors, 4)):
        with pytest.raises(ValueError, match="between the snapshot's anchors"):
            refused()


def test_ranges_of_sorted_sets_replay(spark):
    z = [b"1", b"a", b"2", b"b", b"3", b"c", b"4", b"d", b"5", b"e"]
    log = [(1, 0, "ZADD", b"r", *z), (2, 0, "ZREMRANGEBYRANK", b"r", b"0", b"-4"), (3, 0, "ZADD", b"s", *z), (4, 0, "ZREMRANGEBYSCORE", b"s", b"(2", b"4"), (5, 0, "ZADD", b"l", *z), (6, 0, "ZREMRANGEBYLEX", b"l", b"-", b"(c"), (7, 0, "ZREMRANGEBYLEX", b"l", b"[e", b"+")]
    got = {}
    for r in fold.fold(records(spark, log)).collect():
        got.setdefault(bytes(r.key), set()).add(bytes(r.field))
    assert got == {b"r": {b"c", b"d", b"e"}, b"s": {b"a", b"b", b"e"}, b"l": {b"c", b"d"}}
    with pytest.raises(Exception, match="resolved when written"):
        fold.fold(records(spark, [(1, 0, "RENAME", b"a", b"b")])).collect()


@pytest.mark.parametrize("condition, want", [(None, 7000), ("nx", 5000), ("gt", 9000), ("lt", 2000), ("xx", None)])
def test_a_key_asked_to_expire_more_than_once(spark, condition, want):
    keys = spark.createDataFrame([("a", 0), ("b", 4000)], "key string, expire_at_ms bigint")
    asks = spark.createDataFrame([("a", 5000, 1), ("a", 9000, 2), ("a", 2000, 3), ("a", 7000, 4), ("b", 3000, 1), ("b", 6000, 2)], "key string, amount bigint, seq int")
    out = {r.key: r.expire_at_ms for r in generic.expire(keys, asks, 1000, "ms", True, condition).collect()}
    # No expiry counts as infinite: nothing is greater.
    assert out == {"a": {"xx": 0, "gt": 0}.get(condition, want), "b": {None: 6000, "nx": 4000, "gt": 6000, "lt": 3000, "xx": 6000}[condition]}


def test_more_patterns_than_one_plan_takes(spark):
    subs = spark.createDataFrame([(k % 7, "pattern", f"ch{k}*") for k in range(2001)], "client bigint, kind string, name string")
    found = pubsub.pattern_channels(spark.createDataFrame([("ch2000",), ("other",)], "channel string"), subs).collect()
    assert sorted(r.pattern for r in found) == ["ch2*", "ch20*", "ch200*", "ch2000*"]


def test_zadd_conditions_merge(spark):
    z = spark.createDataFrame([("k", "old", 5.0)], "key string, member string, score double")
    adds = spark.createDataFrame([("k", m, s, i) for m in ("old", "new") for i, s in enumerate((4.0, 9.0, 6.0))], "key string, member string, score double, seq int")
    scores = lambda **o: {r.member: r.score for r in zsets.zadd(z, adds, **o)[0].collect()}
    assert scores() == {"old": 6.0, "new": 6.0} and scores(nx=True) == {"old": 5.0, "new": 4.0} and scores(xx=True) == {"old": 6.0}
    assert scores(gt=True) == {"old": 9.0, "new": 9.0} and scores(lt=True) == {"old": 4.0, "new": 4.0} and scores(xx=True, gt=True) == {"old": 9.0}
    assert [tuple(r) for r in zsets.zadd(z, adds, gt=True)[1].collect()] == [("k", 1, 1)]
    assert "collect_list" not in zsets.zadd(z, adds, gt=True)[0]._jdf.queryExecution().toString()
