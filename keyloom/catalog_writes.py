"""Registered queries that write into stored values, and scans by pattern and type."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _H, _K, _L, _Z, NOW_MS, customers, order_fields, order_keys, query, user_events
from .operators import generic, hashes, lists, strings, zsets
from .plans import effects
from .sources.readers import table

_ADDS = "a AS (SELECT c_mktsegment AS key, 'Customer#' || printf('%09d', c_custkey * 2) AS member, c_acctbal + (c_custkey % 7 - 3) * 1000 AS score, c_custkey AS seq FROM customer)"
_BOTH = f"WITH {_Z}, {_ADDS} SELECT coalesce(z.key, a.key) AS key, coalesce(z.member, a.member) AS member, "


def _adds(spark, d):
    """An add of every customer: the name of twice its key, in its own segment, so that some are stored and some new."""
    shift = (F.col("c_custkey") % 7 - 3) * 1000
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("key"), F.format_string("Customer#%09d", F.col("c_custkey") * 2).alias("member"), (F.col("c_acctbal") + shift).alias("score"), F.col("c_custkey").alias("seq"))


@query(_BOTH + "coalesce(a.score, z.score) AS score FROM z FULL JOIN a USING (key, member)")
def zadd_stored(spark, d):
    return zsets.zadd(customers(spark, d), _adds(spark, d))[0]


@query(_BOTH + "coalesce(z.score, a.score) AS score FROM z FULL JOIN a USING (key, member)")
def zadd_nx_stored(spark, d):
    return zsets.zadd(customers(spark, d), _adds(spark, d), nx=True)[0]


@query(f"WITH {_Z}, {_ADDS} SELECT key, member, coalesce(a.score, z.score) AS score FROM z LEFT JOIN a USING (key, member)")
def zadd_xx_stored(spark, d):
    return zsets.zadd(customers(spark, d), _adds(spark, d), xx=True)[0]


@query(_BOTH + "greatest(z.score, a.score) AS score FROM z FULL JOIN a USING (key, member)")
def zadd_gt_stored(spark, d):
    return zsets.zadd(customers(spark, d), _adds(spark, d), gt=True)[0]


@query(_BOTH + "least(z.score, a.score) AS score FROM z FULL JOIN a USING (key, member)")
def zadd_lt_stored(spark, d):
    return zsets.zadd(customers(spark, d), _adds(spark, d), lt=True)[0]


@query(f"WITH {_Z}, {_ADDS} SELECT key, count(*) FILTER (WHERE z.score IS NULL) AS added, count(*) FILTER (WHERE z.score <> a.score) AS changed FROM a LEFT JOIN z USING (key, member) GROUP BY key")
def zadd_counts(spark, d):
    return zsets.zadd(customers(spark, d), _adds(spark, d))[1]


@query(_BOTH + "coalesce(z.score, 0) + coalesce(a.score, 0) AS score FROM z FULL JOIN a USING (key, member)")
def zincrby_stored(spark, d):
    return zsets.zincrby(customers(spark, d), _adds(spark, d))


@query(f"WITH {_H}, n AS (SELECT o_orderkey * 2 AS key, 'cents' AS field, o_custkey AS delta FROM orders) SELECT coalesce(h.key, n.key) AS key, coalesce(h.field, n.field) AS field, CASE WHEN delta IS NULL THEN value ELSE CAST(coalesce(CAST(value AS BIGINT), 0) + delta AS VARCHAR) END AS value FROM h FULL JOIN n USING (key, field)")
def hincrby_stored(spark, d):
    deltas = table(spark, d, "orders").select((F.col("o_orderkey") * 2).alias("key"), F.lit("cents").alias("field"), F.col("o_custkey").alias("delta"))
    return hashes.hincrby(order_fields(spark, d), deltas)


@query(f"WITH {_H}, n AS (SELECT o_orderkey * 2 AS key, 'status' AS field, o_orderpriority AS value FROM orders) SELECT coalesce(h.key, n.key) AS key, coalesce(h.field, n.field) AS field, coalesce(n.value, h.value) AS value FROM h FULL JOIN n USING (key, field)")
def hset_stored(spark, d):
    new = table(spark, d, "orders").select((F.col("o_orderkey") * 2).alias("key"), F.lit("status").alias("field"), F.col("o_orderpriority").alias("value"), F.lit(1).alias("seq"))
    return hashes.hset(order_fields(spark, d), new)[0]


@query(f"WITH {_H}, n AS (SELECT o_orderkey * 2 AS key, 'status' AS field, o_orderpriority AS value FROM orders) SELECT coalesce(h.key, n.key) AS key, coalesce(h.field, n.field) AS field, coalesce(h.value, n.value) AS value FROM h FULL JOIN n USING (key, field)")
def hsetnx_stored(spark, d):
    new = table(spark, d, "orders").select((F.col("o_orderkey") * 2).alias("key"), F.lit("status").alias("field"), F.col("o_orderpriority").alias("value"), F.lit(1).alias("seq"))
    return hashes.hsetnx(order_fields(spark, d), new)


def _names(spark, d):
    """Strings: customer -> name."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))


def _balances(spark, d):
    """Strings: customer -> balance in cents."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.round(F.col("c_acctbal") * 100).cast("bigint").cast("string").alias("value"))


@query("WITH s AS (SELECT c_custkey AS key, CAST(round(c_acctbal * 100) AS BIGINT) AS v FROM customer), n AS (SELECT o_custkey AS key, CAST(sum(o_orderkey) AS BIGINT) AS delta FROM orders GROUP BY 1) SELECT coalesce(s.key, n.key) AS key, CAST(coalesce(v, 0) + coalesce(delta, 0) AS VARCHAR) AS value FROM s FULL JOIN n USING (key)")
def incrby_stored(spark, d):
    return strings.incrby(_balances(spark, d), table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("delta")))


@query("WITH s AS (SELECT c_custkey AS key, c_name AS v FROM customer), n AS (SELECT o_custkey AS key, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS more FROM orders GROUP BY 1) SELECT coalesce(s.key, n.key) AS key, coalesce(v, '') || coalesce(more, '') AS value FROM s FULL JOIN n USING (key)")
def append_stored(spark, d):
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("value"))
    return strings.append(_names(spark, d), new)


@query("SELECT c_custkey AS key, c_name AS value FROM customer")
def msetnx_refused(spark, d):
    """One key of the set exists already, so none is written."""
    s = _names(spark, d)
    new = table(spark, d, "orders").select((F.col("o_orderkey") + 0).alias("key"), F.col("o_orderstatus").alias("value"), F.lit(1).alias("seq"))
    return strings.msetnx(s, new, s)


@query("SELECT c_custkey AS key, c_name AS value FROM customer UNION ALL SELECT -1 - o_orderkey, o_orderstatus FROM orders")
def msetnx_done(spark, d):
    s = _names(spark, d)
    new = table(spark, d, "orders").select((F.lit(-1) - F.col("o_orderkey")).alias("key"), F.col("o_orderstatus").alias("value"), F.lit(1).alias("seq"))
    return strings.msetnx(s, new, s)


_PUSHED = "p AS (SELECT o_custkey AS key, o_orderkey AS seq, o_orderstatus AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)"


def _pushes(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("value"))


@query(f"WITH {_L}, {_PUSHED}, e AS (SELECT key, max(pos) AS last FROM l GROUP BY key) SELECT key, pos, value FROM l UNION ALL SELECT p.key, coalesce(e.last, -1) + k, p.value FROM p LEFT JOIN e USING (key)")
def rpush_stored(spark, d):
    return lists.push(user_events(spark, d), _pushes(spark, d))[0]


@query(f"WITH {_L}, {_PUSHED}, e AS (SELECT key, min(pos) AS first FROM l GROUP BY key) SELECT key, pos, value FROM l UNION ALL SELECT p.key, e.first - k, p.value FROM p JOIN e USING (key)")
def lpushx_stored(spark, d):
    return lists.push(user_events(spark, d), _pushes(spark, d), lists.LEFT, existing_only=True)[0]


def _stamps(condition: str) -> str:
    live = f"WITH {_K}, r AS (SELECT key, expire_at_ms AS old, {NOW_MS} + (key % 5000 + 1) * 1000000 AS till FROM k WHERE expire_at_ms = 0 OR expire_at_ms > {NOW_MS}) "
    return live + f"SELECT key, CASE WHEN {condition} THEN till ELSE old END AS expire_at_ms FROM r"


def _expire(spark, d, condition):
    k = order_keys(spark, d)
    asks = k.select("key", ((F.col("key") % 5000 + 1) * 1_000_000).alias("amount"))
    return generic.expire(k, asks, NOW_MS, unit="ms", condition=condition).select("key", "expire_at_ms")


@query(_stamps("true"))
def pexpire(spark, d):
    return _expire(spark, d, None)


@query(_stamps("old = 0"))
def pexpire_nx(spark, d):
    return _expire(spark, d, "nx")


@query(_stamps("old <> 0"))
def pexpire_xx(spark, d):
    return _expire(spark, d, "xx")


@query(_stamps("old = 0 OR till < old"))
def pexpire_lt(spark, d):
    return _expire(spark, d, "lt")


@query(f"WITH {_K} SELECT key, {NOW_MS} + (key % 9 + 1) * 1000 AS expire_at_ms FROM k WHERE expire_at_ms = 0 OR expire_at_ms > {NOW_MS}")
def expireat(spark, d):
    """EXPIREAT, asked for three times a key: the last request stands."""
    k = order_keys(spark, d)
    asks = k.select("key", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seq"))
    asks = asks.select("key", "seq", (F.lit(NOW_MS // 1000) + (F.col("key") % 9 + 1) + (3 - F.col("seq")) * 50).alias("amount"))
    return generic.expire(k, asks, NOW_MS, absolute=True).select("key", "expire_at_ms")


def _pages(scan, pages: int):
    out = scan(0)
    for cursor in range(1, pages):
        out = out.unionByName(scan(cursor))
    return out


@query(f"WITH {_K} SELECT key FROM k WHERE CAST(key AS VARCHAR) LIKE '1%'")
def scan_match_type(spark, d):
    """SCAN MATCH 1* TYPE hash, all pages."""
    k = order_keys(spark, d).withColumn("key", F.col("key").cast("string"))
    return _pages(lambda c: generic.scan(k, c, 3, match="1*", kind="hash"), 3).select(F.col("key").cast("bigint").alias("key"))


@query("SELECT o_orderkey AS key FROM orders WHERE false")
def scan_other_type(spark, d):
    return generic.scan(order_keys(spark, d), 0, 3, kind="list").select("key")


@query(f"WITH {_H} SELECT key, field FROM h WHERE field LIKE '%t%'")
def hscan_novalues(spark, d):
    h = order_fields(spark, d)
    return _pages(lambda c: hashes.hscan(h, c, 3, match="*t*", novalues=True), 3).select("key", "field")


@query(f"WITH {_Z} SELECT key, member, score FROM z WHERE member LIKE '%3_'")
def zscan_match(spark, d):
    z = customers(spark, d)
    return _pages(lambda c: zsets.zscan(z, c, 4, match="*3?"), 4).select("key", "member", "score")


@query("WITH m AS (SELECT user_id, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY user_id) SELECT user_id AS txn, first AS offset FROM m WHERE first = last OR user_id % 2 = 0")
def watch_multi_key(spark, d):
    """The watched user is the second key of every record; even users are watched after their last one."""
    e = table(spark, d, "events")
    ends = e.groupBy(F.col("user_id").alias("txn")).agg(F.min("event_id").alias("offset"), F.max("event_id").alias("last"))
    seen = F.when(F.col("txn") % 2 == 0, F.col("last")).otherwise(F.col("offset"))
    first, watched = ends.drop("last"), ends.select("txn", F.lit(0).alias("db"), F.col("txn").cast("string").cast("binary").alias("key"), seen.alias("seen"))
    args = F.array(F.lit(b"other"), F.col("user_id").cast("string").cast("binary"))
    return effects.transaction(first, watched, e.select(F.col("event_id").alias("offset"), F.lit(0).alias("db"), F.lit("DEL").alias("verb"), args.alias("args")))
