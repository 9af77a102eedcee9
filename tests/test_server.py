"""Access rules, the wire protocol, configuration, replicas and blocking pops of sorted sets."""

import math
import random

import pytest

from keyloom.plans import access, positions, server
from keyloom.sources import readers, wire
from keyloom.streaming import jobs


def test_rules_in_order_and_all_or_none():
    users = access.set_user(access.open_users(), "bob", ["on", ">pw", "~b:*", "&news.*", "+@read", "-get"])
    bob = users["bob"]
    assert bob.accepts("pw") and not bob.accepts("no") and "mget" in bob.commands and "get" not in bob.commands
    again = access.set_user({}, "bob", bob.line().split()[2:])
    assert again["bob"] == bob
    with pytest.raises(ValueError):
        access.set_user(users, "bob", ["off", "+nothing"])
    assert users["bob"].enabled
    assert access.set_user(users, "bob", ["get", "reset"][1:])["bob"].line() == "user bob off -@all"
    assert not access.set_user(users, "bob", ["off"])["bob"].accepts("pw")
    assert access.del_user(users, ["bob", "eve"])[1] == 1
    with pytest.raises(ValueError):
        access.del_user(users, ["default"])
    assert len(access.genpass(10)) == 3 and "get" in access.cat("string") and access.open_users("x")["default"].accepts("x")


def test_decide(spark):
    users = access.set_user(access.open_users(), "bob", ["on", "nopass", "~b:*", "&news.*", "+@all", "-del"])
    users = access.set_user(users, "off", ["+@all", "~*", "&*"])
    rows = [("bob", "get", ["b:1"]), ("bob", "mget", ["b:1", "c"]), ("bob", "DEL", ["b:1"]), ("bob", "publish", ["news.x", "t"]), ("bob", "publish", ["old", "t"]), ("off", "get", ["a"]), ("no", "get", ["a"]), ("default", "flushall", []), ("bob", "ping", None)]
    out = access.decide(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, user string, verb string, args array<string>"), users)
    assert [r.denied for r in out.orderBy("id").collect()] == [None, "key", "command", None, "channel", "user", "user", None, None]


def test_keys_of_commands():
    assert positions.get_keys("MSET", ["a", 1, "b", 2]) == ["a", "b"]
    assert positions.get_keys("BLPOP", ["a", "b", "0"]) == ["a", "b"]
    assert positions.get_keys("zinter", ["2", "a", "b"]) == ["a", "b"]
    for verb in ("PING", "SCAN", "GET"):
        with pytest.raises(ValueError):
            positions.get_keys(verb, [])


def test_requests(spark, tmp_path):
    rng = random.Random(1)
    made = [[bytes(rng.randrange(256) for _ in range(rng.randrange(20))) for _ in range(rng.randrange(1, 5))] for _ in range(50)]
    data = b"".join(wire.encode_request(a) for a in made)
    assert [a for _, a in wire.parse_requests(data)] == made
    assert [a for _, a in wire.parse_requests(data[:-1])] == made[:-1]
    mixed = b'SET k "a\\xff"\r\n\r\n*0\r\n*1\r\n$4\r\nPING\r\nGET caf\xc3\xa0\n'
    assert [a for _, a in wire.parse_requests(mixed)] == [[b"SET", b"k", b"a\xff"], [b"PING"], [b"GET", b"caf\xc3\xa0"]]
    for bad in (b"*x\r\n", b"*-2\r\n", b"*1\r\n+OK\r\n", b"*1\r\n$-1\r\n", b"*1\r\n$1\r\nabc", b"*1\r\n$+\r\n"):
        with pytest.raises(wire.ProtocolError):
            list(wire.parse_requests(bad))
    (tmp_path / "a.bin").write_bytes(mixed)
    got = wire.read_requests(spark, str(tmp_path)).orderBy("at").collect()
    assert [(r.verb, [bytes(a) for a in r.args]) for r in got] == [("SET", [b"k", b"a\xff"]), ("PING", []), ("GET", [b"caf\xc3\xa0"])]


def test_replies(spark):
    tree = {b"a": [1, None, True, 2.5, wire.Reply("set", [b"x"])], b"b": wire.Reply("verbatim", b"text"), b"c": wire.Reply("null-array"), b"d": wire.Reply("big", 1 << 70)}
    new = dict(tree) | {b"c": None}
    assert wire.decode_reply(wire.encode_reply(tree, 3))[0] == new
    old = wire.decode_reply(wire.encode_reply(tree, 2))[0]
    assert old == [b"a", [1, None, 1, b"2.5", [b"x"]], b"b", b"text", b"c", wire.Reply("null-array"), b"d", str(1 << 70).encode()]
    assert wire.encode_reply(wire.Reply("error", "ERR no")) == b"-ERR no\r\n" and wire.encode_reply("é") == b"$2\r\n\xc3\xa9\r\n"
    assert [wire.reply_number(x) for x in (3.0, -0.5, math.inf, -math.inf, math.nan, 0.1)] == ["3", "-0.5", "inf", "-inf", "nan", "0.10000000000000001"]
    for torn in (b"$5\r\nabc", b"*2\r\n:1\r\n", b"?1\r\n"):
        with pytest.raises(wire.ProtocolError):
            wire.decode_reply(torn)
    df = spark.createDataFrame([(["a", None, "é"],), (None,)], "v array<string>")
    assert [bytes(r[0]) for r in df.select(wire.reply_bytes(df.v, "array")).collect()] == [wire.encode_reply([b"a", None, "é"]), b"*-1\r\n"]


def test_configuration(spark):
    config = server.config_set({"appendonly": "no"}, {"MAXMEMORY": "1kb", "maxmemory-policy": "allkeys-lfu", "appendonly": "yes"})
    assert config == {"appendonly": "yes", "maxmemory": "1000", "maxmemory-policy": "allkeys-lfu"}
    for bad in ({"maxmemory": "1", "nope": "1"}, {"shards": "32"}, {"slowlog-max-len": "x"}, {"maxmemory-policy": "x"}, {"active-expire": "maybe"}):
        with pytest.raises(ValueError):
            server.config_set(config, bad)
    got = server.config_get(spark, config, ["maxmemory*", "MAXmemory"])
    assert {r.name: r.value for r in got.collect()} == {"maxmemory": "1000", "maxmemory-policy": "allkeys-lfu"}
    usage = spark.createDataFrame([(90,), (10,)], "bytes long")
    assert [server.memory_doctor(usage, m).first().advice for m in (0, 111, 112, 1000)] == ["no-limit", "near-limit", "none", "none"]


def test_replicas(spark):
    log = spark.createDataFrame([(i,) for i in range(5, 10)], "offset long")
    acks = spark.createDataFrame([("a", 3), ("a", 10), ("b", 9), ("c", 10)], "replica string, offset long")
    assert tuple(server.wait(log, acks, 2).first()) == (10, 2, True)
    assert tuple(server.wait(log, acks.limit(0), 1).first()) == (10, 0, False)
    assert [server.sync_kind(log, same, at) for same, at in ((True, 7), (True, 10), (True, 4), (True, 11), (False, 7), (True, None))] == ["continue", "continue"] + ["full"] * 4


DDL = "queue string, seq bigint, at_ms bigint, kind string, client bigint, value string, score double, deadline_ms bigint, side string, ts timestamp"


def test_sorted_pops_deadlines_and_moves(spark, tmp_path):
    import datetime as dt

    at = lambda s: dt.datetime(2026, 1, 1, 0, 0, s)
    ms = lambda s: int(dt.datetime(2026, 1, 1, 0, 0, s, tzinfo=dt.timezone.utc).timestamp() * 1000)
    rows = [("z", 0, ms(1), "push", None, "b", 2.0, 0, None, at(1)), ("z", 1, ms(1), "push", None, "a", 2.0, 0, None, at(1)), ("z", 2, ms(1), "push", None, "b", 3.0, 0, None, at(1)), ("z", 3, ms(1), "pop", 7, None, None, 0, "max", at(1)), ("z", 4, ms(1), "pop", 8, None, None, 0, "min", at(1)), ("z", 5, ms(1), "pop", 9, None, None, ms(3), "min", at(1))]
    later = [("other", 6, ms(20), "push", None, "x", None, 0, None, at(20))]
    src = str(tmp_path / "q")
    for i, part in enumerate((rows, later, [("other", 7, ms(30), "push", None, "y", None, 0, None, at(30))])):
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(f"{src}")
    out = jobs.run_to_table(jobs.blocking_pops(jobs.tail(spark, src, DDL, files=1)), "zpops", "append", out=str(tmp_path / "out"))
    got = sorted((r.client, r.value, r.score) for r in out.collect())
    # The queue stays quiet after its last pop; the timer answers it.
    assert got == [(7, "b", 3.0), (8, "a", 2.0), (9, None, None)]
    moves = spark.createDataFrame([(3, 0, "dst", "left"), (5, 0, "dst", "right")], "seq bigint, db int, destination string, into string")
    assert [(r.offset, r.verb, [bytes(a) for a in r.args]) for r in jobs.moved(out, moves).collect()] == [(3, "LPUSH", [b"dst", b"b"])]


def test_inline_words_are_bytes():
    assert readers.parse_inline("SET cafà 'x y'") == [b"SET", "cafà".encode(), b"x y"]
    assert readers.parse_inline('SET "\\xff"') == [b"SET", b"\xff"]
