"""Registered queries of canonical effects, key and channel tables, and what a server reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .catalog import _EVICT, _H, _K, _M, _Z, NOW_MS, _sized_keys, customers, flag_parts, order_fields, order_keys, query
from .catalog_more import _CMD, _timed
from .operators import generic, hashes, introspection, lists, pubsub, sets, zsets
from .plans import effects, server
from .sources.readers import table


def _db() -> Column:
    return F.lit(0).alias("db")


def _shown(rows: DataFrame) -> DataFrame:
    """Log rows as text."""
    args = F.array_join(F.transform("args", lambda a: a.cast("string")), " ")
    return rows.select("offset", F.concat_ws(" ", "verb", args).alias("record"))


def _sets(spark, d, **options) -> DataFrame:
    """A SET of every order; the keys that exist are twice the orders'."""
    o = table(spark, d, "orders")
    given = {"nx": False, "xx": False, "keepttl": False, "amount": None, "unit": "s", "absolute": False} | options
    kinds = {"amount": "bigint", "unit": "string"}
    cols = [F.lit(v).cast(kinds.get(c, "boolean")).alias(c) for c, v in given.items()]
    asks = o.select(F.col("o_orderkey").alias("offset"), _db(), F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("value"), *cols)
    there = o.select(_db(), (F.col("o_orderkey") * 2).cast("string").alias("key"))
    return _shown(effects.set_effects(asks, there, NOW_MS))


@query("SELECT o_orderkey AS \"offset\", 'SET ' || o_orderkey || ' ' || o_orderstatus AS record FROM orders")
def set_effect(spark, d):
    return _sets(spark, d)


@query("SELECT o_orderkey AS \"offset\", 'SET ' || o_orderkey || ' ' || o_orderstatus AS record FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey * 2 FROM orders)")
def setnx_effect(spark, d):
    return _sets(spark, d, nx=True)


@query("SELECT o_orderkey AS \"offset\", 'SET ' || o_orderkey || ' ' || o_orderstatus || ' KEEPTTL' AS record FROM orders WHERE o_orderkey IN (SELECT o_orderkey * 2 FROM orders)")
def set_xx_keepttl_effect(spark, d):
    return _sets(spark, d, xx=True, keepttl=True)


@query(f"SELECT o_orderkey AS \"offset\", 'SET ' || o_orderkey || ' ' || o_orderstatus || ' PXAT {NOW_MS + 60_000}' AS record FROM orders")
def setex_effect(spark, d):
    return _sets(spark, d, amount=60)


@query(f"SELECT o_orderkey AS \"offset\", 'SET ' || o_orderkey || ' ' || o_orderstatus || ' PXAT {NOW_MS + 1500}' AS record FROM orders")
def psetex_effect(spark, d):
    return _sets(spark, d, amount=1500, unit="ms")


@query(f"WITH {_K} SELECT key AS \"offset\", CASE WHEN {NOW_MS} - 500000 + key * 1000 <= {NOW_MS} THEN 'DEL ' || key ELSE 'PEXPIREAT ' || key || ' ' || ({NOW_MS} - 500000 + key * 1000) END AS record FROM k WHERE expire_at_ms <> 0 AND {NOW_MS} - 500000 + key * 1000 < expire_at_ms")
def expire_effect(spark, d):
    """PEXPIREAT XX LT of every order: instants that have passed delete."""
    k = order_keys(spark, d).select(_db(), F.col("key").cast("string").alias("key"), "expire_at_ms").filter("expire_at_ms <> 0")
    asks = table(spark, d, "orders").select(F.col("o_orderkey").alias("offset"), _db(), F.col("o_orderkey").cast("string").alias("key"), (F.lit(NOW_MS - 500_000) + F.col("o_orderkey") * 1000).alias("amount"))
    return _shown(effects.expire_effects(asks, k, NOW_MS, unit="ms", absolute=True, condition="lt"))


@query(f"WITH {_K} SELECT CAST(9 AS BIGINT) AS \"offset\", 'DEL ' || key AS record FROM k WHERE expire_at_ms <> 0 AND expire_at_ms <= {NOW_MS}")
def sweep_effect(spark, d):
    k = order_keys(spark, d).select(_db(), F.col("key").cast("string").alias("key"), "expire_at_ms")
    return _shown(effects.sweep_effects(k, NOW_MS, 9))


@query(f"WITH {_Z} SELECT CAST(9 AS BIGINT) AS \"offset\", 'ZADD ' || key || ' ' || CAST(10000 AS VARCHAR) || ' ' || member AS record FROM z WHERE score < 0")
def zadd_effect(spark, d):
    """ZADD GT: only what a floor of 10000 for negative balances changed is logged."""
    before = customers(spark, d).select(_db(), "key", "member", "score")
    adds = before.filter("score < 0").withColumn("score", F.lit(10_000.0)).withColumn("seq", F.lit(1))
    return _shown(effects.zadd_effects(before, zsets.zadd(before, adds, gt=True)[0], 9))


@query(f"WITH {_Z} SELECT CAST(9 AS BIGINT) AS \"offset\", 'ZREM ' || key || ' ' || member AS record FROM z QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) <= 3")
def zpop_effect(spark, d):
    popped = zsets.zpop(customers(spark, d).select(_db(), "key", "member", "score"), 3, highest=True)
    return _shown(effects.zpop_effects(popped, 9))


@query(f"WITH {_M} SELECT CAST(9 AS BIGINT) AS \"offset\", 'SREM ' || key || ' ' || member AS record FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY md5('11' || member), CAST(member AS VARCHAR)) <= 10")
def spop_effect(spark, d):
    m = flag_parts(spark, d).select(_db(), "key", F.col("member").cast("string").alias("member"))
    return _shown(effects.spop_effects(m, 10, 11, 9))


@query(f"WITH {_H} SELECT key, field, value FROM h QUALIFY row_number() OVER (PARTITION BY key ORDER BY md5('3' || field), field) <= 2")
def hrandfield_seeded(spark, d):
    return hashes.hrandfield(order_fields(spark, d), 2, 3)


@query(f"WITH {_M} SELECT key, member FROM m WHERE CAST(member AS VARCHAR) LIKE '1%'")
def sscan_match(spark, d):
    """All pages of SSCAN with a pattern."""
    m = flag_parts(spark, d).withColumn("member", F.col("member").cast("string"))
    out = sets.sscan(m, 0, 3, "1*")
    for c in (1, 2):
        out = out.unionByName(sets.sscan(m, c, 3, "1*"))
    return out.select("key", F.col("member").cast("bigint").alias("member"))


@query("SELECT o_orderkey AS key FROM orders ORDER BY md5('5' || o_orderkey), o_orderkey LIMIT 1")
def randomkey_seeded(spark, d):
    return sets.randomkey(order_keys(spark, d), 5).select("key")


@query("SELECT DISTINCT l.user_id AS key, l.value FROM (SELECT user_id, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) l WHERE r <= 2 GROUP BY ALL")
def rpop_values(spark, d):
    """RPOP 2: the distinct values that come out of each list."""
    l = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), F.col("event_type").alias("value"))
    return lists.pop(l, 2, lists.RIGHT)[0].select("key", "value").distinct()


@query(f"WITH {_EVICT} SELECT key, CASE WHEN key IN (SELECT user_id * 2 FROM events) THEN {NOW_MS} ELSE last END AS last_access_ms FROM e")
def touch(spark, d):
    """TOUCH of twice every user's key: some exist, some do not."""
    k = _sized_keys(spark, d)
    asks = table(spark, d, "events").select((F.col("user_id") * 2).alias("key"))
    return generic.touch(k, asks, NOW_MS).select("key", "last_access_ms")


@query(f"WITH {_EVICT} SELECT key, 1 AS refcount, CAST(bytes / 100 AS INT) AS freq, CAST(floor(({NOW_MS} - last) / 1000) AS BIGINT) AS idletime FROM e")
def object_info(spark, d):
    """OBJECT REFCOUNT, FREQ, IDLETIME."""
    return introspection.object_info(_sized_keys(spark, d), NOW_MS)


@query(f"WITH {_Z} SELECT CASE key WHEN 'BUILDING' THEN 'MACHINERY' ELSE key END AS key, member, score FROM z WHERE key <> 'MACHINERY'")
def rename(spark, d):
    return generic.rename(customers(spark, d), "BUILDING", "MACHINERY")


def _subscriptions(spark, d) -> DataFrame:
    """Every user listens to the types of its events, and to the pattern of their first letter."""
    e = table(spark, d, "events").select(F.col("user_id").alias("client"), F.col("event_type").alias("name"))
    subs = pubsub.subscribe(e.select("client", F.lit("channel").alias("kind"), "name").limit(0), e.select("client", F.lit("channel").alias("kind"), "name"))
    return pubsub.subscribe(subs, e.select("client", F.lit("pattern").alias("kind"), F.concat(F.substring("name", 1, 1), F.lit("*")).alias("name")))


@query("SELECT DISTINCT event_type AS name FROM events WHERE event_type LIKE 'c%'")
def pubsub_channels(spark, d):
    return pubsub.channels(_subscriptions(spark, d), "c*")


@query("SELECT count(DISTINCT substr(event_type, 1, 1)) AS n FROM events")
def pubsub_numpat(spark, d):
    return pubsub.numpat(_subscriptions(spark, d))


@query("WITH s AS (SELECT DISTINCT user_id AS client, 'channel' AS kind, event_type AS name FROM events UNION SELECT user_id, 'pattern', substr(event_type, 1, 1) || '*' FROM events) SELECT * FROM s WHERE NOT (client = 7 AND kind = 'channel') AND NOT (client = 8 AND kind = 'pattern' AND name = 'c*')")
def unsubscribe(spark, d):
    """UNSUBSCRIBE of all by one client, PUNSUBSCRIBE of one pattern by another."""
    left = pubsub.unsubscribe(_subscriptions(spark, d), 7, "channel")
    return pubsub.unsubscribe(left, 8, "pattern", ["c*"])


@query(f"WITH {_EVICT} SELECT CAST(sum(bytes) AS BIGINT) AS bytes, CASE WHEN sum(bytes) * 10 >= 1000000 * 9 THEN 'near-limit' ELSE 'none' END AS advice FROM e")
def memory_doctor(spark, d):
    return server.memory_doctor(_sized_keys(spark, d), 1_000_000)


@query(f"WITH {_CMD} SELECT 'keyloom_commandstats_' || k || '{{name=\"cmdstat_' || command || '\"}} ' || v AS line FROM (SELECT lower(verb) AS command, unnest(['calls', 'usec', 'failed_calls']) AS k, unnest([count(*), sum(id % 30000), count(*) FILTER (WHERE id % 11 = 0)]) AS v FROM c GROUP BY 1)")
def metrics(spark, d):
    k = order_keys(spark, d).withColumn("db", _db())
    return server.metrics(server.info_sections(k, _timed(spark, d), {}, NOW_MS, ["commandstats"]))
