"""A snapshot is there only once committed; the log rolls and is pruned below it."""

import pytest

from keyloom.plans import fold, snapshot
from keyloom.sources import segments


def _log(spark, first, n):
    return spark.createDataFrame([(o, 0, "SET", [b"k%d" % (o % 5), b"%d" % o]) for o in range(first, first + n)], "offset bigint, db int, verb string, args array<binary>")


def test_commit_roll_and_prune(spark, tmp_path):
    log, snap = str(tmp_path / "log"), str(tmp_path / "snap")
    assert segments.append(_log(spark, 0, 10), log) == 0 and segments.append(_log(spark, 10, 10), log) == 0
    assert segments.append(_log(spark, 20, 10), log, max_bytes=1) == 1 and segments.roll(_log(spark, 30, 10), log) == 2
    assert {tuple(r) for r in segments.bounds(spark, log).collect()} == {(0, 0, 19), (1, 20, 29), (2, 30, 39)}
    with pytest.raises(ValueError):
        snapshot.load(spark, snap)
    assert snapshot.rewrite(spark, log, snap) == [] and snapshot.lastsave(spark, snap) == 0
    whole = spark.read.parquet(log).drop("segment")
    state = fold.fold(whole.filter("offset < 25"))
    anchors = spark.createDataFrame([(0, s, 25) for s in range(4)], "db int, shard int, offset bigint")
    assert snapshot.save(state, anchors, snap, 4, 7000) == 1
    # A second one that died before its commit is not seen, and its number is used again.
    (tmp_path / "snap" / "2" / "elements").mkdir(parents=True)
    assert snapshot.lastsave(spark, snap) == 7 and snapshot.load(spark, snap)[1].count() == 4
    assert snapshot.rewrite(spark, log, snap) == [0]
    elements, kept = snapshot.load(spark, snap)
    rest = spark.read.parquet(log).drop("segment")
    snapshot.check_gap(rest, kept)
    values = lambda df: {bytes(r["key"]): bytes(r["value"]) for r in df.collect()}
    got = values(snapshot.recover(elements, rest, kept, 4))
    assert got == {b"k%d" % k: b"%d" % (35 + k) for k in range(5)}
    assert snapshot.save(elements.drop("shard"), anchors, snap, 4) == 2 and snapshot.rewrite(spark, log, snap) == []
    assert not (tmp_path / "snap" / "1").exists()
    with pytest.raises(ValueError):
        snapshot.save(elements, anchors.limit(0), snap, 4)
    assert snapshot.load(spark, snap)[0].count() == 5 and segments.prune(spark, log, 10**9) == [1]
