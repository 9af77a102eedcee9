"""Ranks, running values and evictions when one key holds all rows, or all ranks are close or equal."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators import common, eviction, strings, zsets


def test_ranks_of_one_set_lie_in_many_tasks(spark):
    data = [("hot", f"m{i}", float(i % 7)) for i in range(2000)] + [("b", "x", 1.0), ("a", "y", 2.0)]
    z = spark.createDataFrame(data, "key string, member string, score double").repartition(6)
    few = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(few, "false")  # such small partitions would be read as one
    try:
        _ranks(spark, data, z)
        spread = z.repartitionByRange("key", "score", "member").filter("key = 'hot'").select(F.spark_partition_id()).distinct()
        assert spread.count() > 1
    finally:
        spark.conf.unset(few)


def _ranks(spark, data, z):
    for rev in (False, True):
        got = zsets.zrank(z, rev)
        want = {}
        for key in ("hot", "a", "b"):
            mine = sorted([(s, m) for k, m, s in data if k == key], reverse=rev)
            want |= {(key, m): i for i, (_, m) in enumerate(mine)}
        assert {(r["key"], r["member"]): r["rank"] for r in got.collect()} == want


def test_running_with_clashing_names_and_nulls(spark):
    t = spark.createDataFrame([(None, 1, "p"), (None, 2, "q"), ("k", 1, "r")], "key string, seq int, part string")
    out = common.running(t.withColumn("start", F.lit(5)).withColumn("amount", F.lit(6)), [F.col("seq")], "n")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(None, 1, "p", 5, 6, 1), (None, 2, "q", 5, 6, 2), ("k", 1, "r", 5, 6, 1)], key=repr)
    assert common.running(t.limit(0), [F.col("seq")], "n").count() == 0


def test_replies_start_from_the_stored_value(spark):
    deltas = spark.createDataFrame([("a", 1, 5), ("a", 2, -3), ("new", 1, 1)], "key string, seq int, delta long")
    stored = spark.createDataFrame([("a", "10"), ("other", "text")], "key string, value string")
    out = strings.incr_running(deltas, s=stored)
    assert sorted((r["key"], r["seq"], r["value"]) for r in out.collect()) == [("a", 1, 15), ("a", 2, 12), ("new", 1, 1)]
    with pytest.raises(Exception, match="not an integer"):
        strings.incr_running(deltas, s=spark.createDataFrame([("a", "x")], "key string, value string")).collect()
    top = spark.createDataFrame([("a", str((1 << 63) - 2))], "key string, value string")
    with pytest.raises(Exception, match="overflow"):
        strings.incr_running(deltas, s=top).collect()


@pytest.mark.parametrize("shape", ["equal", "one old", "narrow", "spread", "never"])
def test_evict_against_brute_force(spark, shape):
    rng = random.Random(shape)
    at = {"equal": lambda i: 7, "one old": lambda i: 0 if i == 3 else 10**12 + i % 50, "narrow": lambda i: 10**12 + rng.randrange(3), "spread": lambda i: rng.randrange(10**6), "never": lambda i: None}[shape]
    rows = [(f"k{i:04}", at(i), rng.randrange(1, 90)) for i in range(600)]
    k = spark.createDataFrame([(a, b, c, 0) for a, b, c in rows], "key string, last_access_ms long, bytes long, expire_at_ms long")
    total = sum(r[2] for r in rows)
    for limit in (1, total // 3, total - 5, total + 10):
        left, want = total, set()
        for key, _, n in sorted(rows, key=lambda r: (r[1] or 0, r[0])):
            if left < limit:
                break
            left -= n
            want.add(key)
        assert {r["key"] for r in eviction.evict(k, limit).collect()} == want, limit
