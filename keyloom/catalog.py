"""Registered queries of the keyspace engine and their DuckDB SQL.

Each query maps whole Parquet tables to keyspace tables and applies one family
of operators to every key at once.  Columns are STRING here, so that results
compare with an SQL engine's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import scalars
from .operators import common, eviction, generic, hashes, introspection, lists, pubsub, sets, sorting, strings, zsets
from .operators.live import live
from .plans import fold as folds
from .plans import snapshot
from .sources.readers import table
from .sources.shared import written

#: The instant all queries are asked at, and the life given to orders.
NOW_MS = 820_454_400_000
LIFE_MS = 30 * 86_400_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---- keyspace views of the tables -------------------------------------------------


def customers(spark, d) -> DataFrame:
    """Sorted sets: segment -> (name, balance)."""
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))


def customer_requests(spark, d) -> DataFrame:
    """A member asked for by every customer: the name of twice its key, in its own segment."""
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("key"), F.format_string("Customer#%09d", F.col("c_custkey") * 2).alias("member"))


def part_names(spark, d) -> DataFrame:
    """Sorted sets of one score: brand -> (name and key)."""
    return table(spark, d, "part").select(F.col("p_brand").alias("key"), F.concat_ws(":", "p_name", "p_partkey").alias("member"), F.lit(0.0).alias("score"))


def order_counts(spark, d, status: str) -> DataFrame:
    """A sorted set: customer -> number of orders of a status."""
    o = table(spark, d, "orders").filter(F.col("o_orderstatus") == status)
    return o.groupBy(F.col("o_custkey").alias("member")).agg(F.count("*").cast("double").alias("score"))


def flag_parts(spark, d) -> DataFrame:
    """Sets: return flag -> parts."""
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_partkey").alias("member")).distinct()


def order_fields(spark, d) -> DataFrame:
    """Hashes: order -> status, priority, price in cents."""
    o = table(spark, d, "orders")
    pairs = F.map_from_arrays(F.array(F.lit("status"), F.lit("priority"), F.lit("cents")), F.array("o_orderstatus", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")))
    return o.select(F.col("o_orderkey").alias("key"), F.explode(pairs).alias("field", "value"))


def user_events(spark, d) -> DataFrame:
    """Lists: user -> event types in order."""
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), F.col("event_type").alias("value"))


def order_keys(spark, d) -> DataFrame:
    """Keys: orders that live 30 days from their date; those of status P never expire."""
    o = table(spark, d, "orders")
    day = F.expr("unix_millis(cast(o_orderdate as timestamp))")
    return o.select(F.col("o_orderkey").alias("key"), F.lit("hash").alias("type"), F.when(F.col("o_orderstatus") == "P", F.lit(0)).otherwise(day + LIFE_MS).cast("bigint").alias("expire_at_ms"))


_Z = "z AS (SELECT c_mktsegment AS key, c_name AS member, c_acctbal AS score FROM customer)"
_LEX = "z AS (SELECT p_brand AS key, p_name || ':' || p_partkey AS member, 0.0 AS score FROM part)"
_M = "m AS (SELECT DISTINCT l_returnflag AS key, l_partkey AS member FROM lineitem)"
_H = "h AS (SELECT o_orderkey AS key, unnest(['status', 'priority', 'cents']) AS field, unnest([o_orderstatus, o_orderpriority, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR)]) AS value FROM orders)"
_L = "l AS (SELECT user_id AS key, event_id AS pos, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS ridx, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
_K = f"k AS (SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE epoch_ms(o_orderdate) + {LIFE_MS} END AS expire_at_ms FROM orders)"
_F = "f AS (SELECT o_custkey AS member, CAST(count(*) AS DOUBLE) AS score FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), o AS (SELECT o_custkey AS member, CAST(count(*) AS DOUBLE) AS score FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)"


# ---- sorted sets ------------------------------------------------------------------


@query(f"WITH {_Z} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS idx FROM z) WHERE idx <= 2")
def zrevrange_topk(spark, d):
    return zsets.zrange(customers(spark, d), 0, 2, rev=True)


@query(f"WITH {_Z} SELECT key, member, score, idx FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM z) WHERE idx >= n - 5 AND idx <= n - 2")
def zrange_negative(spark, d):
    return zsets.zrange(customers(spark, d), -5, -2)


@query(f"WITH {_Z} SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM z")
def zrank(spark, d):
    return zsets.zrank(customers(spark, d))


@query(f"WITH {_Z} SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank FROM z")
def zrevrank(spark, d):
    return zsets.zrank(customers(spark, d), rev=True)


@query(f"WITH {_Z} SELECT key, count(*) FILTER (score > 0 AND score <= 5000) AS n FROM z GROUP BY key")
def zcount(spark, d):
    return zsets.zcount(customers(spark, d), "(0", 5000)


@query(f"WITH {_Z} SELECT key, member, score FROM z WHERE score >= 0 AND score < 5000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY score, member) BETWEEN 3 AND 7")
def zrangebyscore_limit(spark, d):
    return zsets.zrangebyscore(customers(spark, d), 0, "(5000", offset=2, limit=5)


@query(f"WITH {_Z} SELECT key, member, score FROM z WHERE score <= 100")
def zrevrangebyscore(spark, d):
    return zsets.zrangebyscore(customers(spark, d), "-inf", 100, rev=True)


@query(f"WITH {_LEX} SELECT key, count(*) FILTER (member >= 'b' AND member < 'm') AS n FROM z GROUP BY key")
def zlexcount(spark, d):
    return zsets.zlexcount(part_names(spark, d), "[b", "(m")


@query(f"WITH {_LEX} SELECT key, member, CAST(score AS DOUBLE) AS score FROM z WHERE member > 'c' QUALIFY row_number() OVER (PARTITION BY key ORDER BY member) <= 4")
def zrangebylex_limit(spark, d):
    return zsets.zrangebylex(part_names(spark, d), "(c", "+", limit=4)


@query(f"WITH {_Z} SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS idx FROM z QUALIFY idx < 4")
def zpopmin(spark, d):
    return zsets.zpop(customers(spark, d), 4)


@query(f"WITH {_Z} SELECT key, member, score FROM z QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) > 4")
def zpopmax_remainder(spark, d):
    return zsets.after_zpop(customers(spark, d), 4, highest=True)


@query(f"WITH {_Z} SELECT key, member, score FROM z QUALIFY row_number() OVER (PARTITION BY key ORDER BY score, member) NOT BETWEEN 2 AND 10")
def zremrangebyrank(spark, d):
    return zsets.zremrangebyrank(customers(spark, d), 1, 9)


@query(f"WITH {_Z} SELECT key, member, score FROM z WHERE NOT (score > 1000 AND score <= 2000)")
def zremrangebyscore(spark, d):
    return zsets.zremrangebyscore(customers(spark, d), "(1000", 2000)


@query(f"WITH {_LEX} SELECT key, member, CAST(score AS DOUBLE) AS score FROM z WHERE NOT (member >= 'a' AND member <= 'k')")
def zremrangebylex(spark, d):
    return zsets.zremrangebylex(part_names(spark, d), "[a", "[k")


@query(f"WITH {_F} SELECT member, sum(s) AS score FROM (SELECT member, score * 2 AS s FROM f UNION ALL SELECT member, score * 0.5 FROM o) GROUP BY member")
def zunion_weighted(spark, d):
    return zsets.zunion(order_counts(spark, d, "F"), order_counts(spark, d, "O"), weights=[2, 0.5])


@query(f"WITH {_F} SELECT member, least(f.score, o.score) AS score FROM f JOIN o USING (member)")
def zinter_min(spark, d):
    return zsets.zinter(order_counts(spark, d, "F"), order_counts(spark, d, "O"), aggregate="min")


@query(f"WITH {_F} SELECT member, f.score FROM f ANTI JOIN o USING (member)")
def zdiff(spark, d):
    return zsets.zdiff(order_counts(spark, d, "F"), order_counts(spark, d, "O"))


@query(f"WITH {_F} SELECT least(count(*), 50) AS n FROM f JOIN o USING (member)")
def zintercard_limit(spark, d):
    return zsets.zintercard(order_counts(spark, d, "F"), order_counts(spark, d, "O"), limit=50)


@query("SELECT 'all' AS key, o_custkey AS member, CAST(count(*) AS DOUBLE) AS score FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY o_custkey")
def zunionstore(spark, d):
    dst = order_counts(spark, d, "P").withColumn("key", F.lit("all"))
    return zsets.zstore(dst, "all", zsets.zunion(order_counts(spark, d, "F"), order_counts(spark, d, "O"))).select("key", "member", "score")


@query("SELECT event_type AS key, user_id AS member, CAST(count(*) AS DOUBLE) AS score FROM events GROUP BY ALL")
def zincrby(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("member"), F.lit(1.0).alias("score"), F.col("event_id").alias("seq"))
    return zsets.zincrby(e.select("key", "member", "score").limit(0), e)


@query("SELECT event_type AS key, user_id AS member, max(value) AS score FROM events GROUP BY ALL")
def zadd_gt(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("member"), F.col("value").alias("score"), F.col("event_id").alias("seq"))
    return zsets.zadd(e.select("key", "member", "score").limit(0), e, gt=True)[0]


@query("SELECT event_type AS key, user_id AS member, arg_min(value, event_id) AS score FROM events GROUP BY ALL")
def zadd_nx(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("member"), F.col("value").alias("score"), F.col("event_id").alias("seq"))
    return zsets.zadd(e.select("key", "member", "score").limit(0), e, nx=True)[0]


@query(f"WITH {_Z}, r AS (SELECT c_mktsegment AS key, 'Customer#' || printf('%09d', c_custkey * 2) AS member FROM customer) SELECT r.key, r.member, z.score FROM r LEFT JOIN z USING (key, member)")
def zmscore(spark, d):
    """One request for every customer."""
    return zsets.zscore(customers(spark, d), customer_requests(spark, d))


@query(f"WITH {_Z} SELECT key, member, score FROM z QUALIFY row_number() OVER (PARTITION BY key ORDER BY md5('7' || member), member) <= 3")
def zrandmember_seeded(spark, d):
    return zsets.zrandmember(customers(spark, d), 3, seed=7)


# ---- sets -------------------------------------------------------------------------


@query(f"WITH {_M} SELECT member FROM m WHERE key = 'A' INTERSECT SELECT member FROM m WHERE key = 'R' INTERSECT SELECT member FROM m WHERE key = 'N'")
def sinter(spark, d):
    return sets.sinter_keys(flag_parts(spark, d), ["A", "R", "N"])


@query(f"WITH {_M} SELECT DISTINCT member FROM m WHERE key IN ('A', 'R')")
def sunion(spark, d):
    m = flag_parts(spark, d)
    return sets.sunion(sets.members(m, "A"), sets.members(m, "R"))


@query(f"WITH {_M} SELECT member FROM m WHERE key = 'N' EXCEPT SELECT member FROM m WHERE key = 'A'")
def sdiff(spark, d):
    m = flag_parts(spark, d)
    return sets.sdiff(sets.members(m, "N"), sets.members(m, "A"))


@query(f"WITH {_M} SELECT least(count(*), 100) AS n FROM (SELECT member FROM m WHERE key = 'A' INTERSECT SELECT member FROM m WHERE key = 'N')")
def sintercard_limit(spark, d):
    m = flag_parts(spark, d)
    return sets.sintercard(sets.members(m, "A"), sets.members(m, "N"), limit=100)


@query(f"WITH {_M} SELECT DISTINCT CASE WHEN key = 'A' AND member = 1 THEN 'R' ELSE key END AS key, member FROM m")
def smove(spark, d):
    return sets.smove(flag_parts(spark, d), "A", "R", 1)


@query(f"WITH {_M}, r AS (SELECT unnest(['A', 'N', 'R']) AS key, p_partkey AS member FROM part) SELECT key, member, CAST(m.member IS NOT NULL AS INT) AS is_member FROM r LEFT JOIN m USING (key, member)".replace("m.member IS NOT NULL", "(key, member) IN (SELECT (key, member) FROM m)").replace(" LEFT JOIN m USING (key, member)", ""))
def smismember(spark, d):
    r = table(spark, d, "part").select(F.explode(F.array(*map(F.lit, "ANR"))).alias("key"), F.col("p_partkey").alias("member"))
    return sets.smismember(flag_parts(spark, d), r)


@query(f"WITH {_M} SELECT key, count(*) AS n FROM m GROUP BY key")
def scard(spark, d):
    return sets.scard(flag_parts(spark, d))


@query(f"WITH {_M} SELECT key, member FROM m WHERE member % 3 <> 0")
def srem(spark, d):
    m = flag_parts(spark, d)
    return sets.srem(m, m.filter("member % 3 = 0"))


@query(f"WITH {_M} SELECT key, member FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY md5('11' || member), member) > 10")
def spop_remainder(spark, d):
    return sets.spop(flag_parts(spark, d), 10, seed=11)[1]


@query(f"WITH {_M}, a AS (SELECT DISTINCT l_returnflag AS key, l_suppkey AS member FROM lineitem) SELECT key, count(*) AS added FROM (SELECT * FROM a EXCEPT SELECT * FROM m) GROUP BY key")
def sadd_count(spark, d):
    new = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("key"), (F.col("l_suppkey")).alias("member"))
    m = flag_parts(spark, d)
    return sets.sadd(m, new)[1]


# ---- hashes -----------------------------------------------------------------------


@query("SELECT o_orderkey AS key, o_orderstatus AS status, o_orderpriority AS priority, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS cents FROM orders")
def hgetall(spark, d):
    m = hashes.hgetall(order_fields(spark, d))
    return m.select("key", *[F.element_at("fields", f).alias(f) for f in ("status", "priority", "cents")])


@query(f"WITH {_H}, r AS (SELECT o_orderkey * 2 AS key, unnest(['status', 'nothing']) AS field FROM orders) SELECT key, field, h.value FROM r LEFT JOIN h USING (key, field)")
def hmget(spark, d):
    r = table(spark, d, "orders").select((F.col("o_orderkey") * 2).alias("key"), F.explode(F.array(F.lit("status"), F.lit("nothing"))).alias("field"))
    return hashes.hget(order_fields(spark, d), r)


@query("SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY o_custkey")
def hlen(spark, d):
    h = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("field"))
    return hashes.hlen(h)


@query(f"WITH {_H} SELECT key, field, strlen(value) AS n FROM h")
def hstrlen(spark, d):
    return hashes.hstrlen(order_fields(spark, d))


@query(f"WITH {_H} SELECT key, field FROM h")
def hkeys(spark, d):
    return hashes.hkeys(order_fields(spark, d))


@query(f"WITH {_H} SELECT key, field, value FROM h WHERE NOT (field = 'priority' AND value LIKE '1%')")
def hdel(spark, d):
    h = order_fields(spark, d)
    return hashes.hdel(h, h.filter("field = 'priority' AND value LIKE '1%'").select("key", "field"))


@query("SELECT o_custkey AS key, o_orderpriority AS field, CAST(count(*) AS VARCHAR) AS value FROM orders GROUP BY ALL")
def hincrby(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("field"), F.lit(1).cast("bigint").alias("delta"))
    return hashes.hincrby(o.select("key", "field", F.lit("0").alias("value")).limit(0), o)


@query("SELECT user_id AS key, event_type AS field, CAST(arg_max(event_id, event_id) AS VARCHAR) AS value FROM events GROUP BY ALL")
def hset_last(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("seq"))
    return hashes.hset(e.drop("seq").limit(0), e)[0]


@query("SELECT user_id AS key, event_type AS field, CAST(min(event_id) AS VARCHAR) AS value FROM events GROUP BY ALL")
def hsetnx_first(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("seq"))
    return hashes.hsetnx(e.drop("seq").limit(0), e)


# ---- lists ------------------------------------------------------------------------


@query(f"WITH {_L} SELECT key, pos, value, idx FROM l WHERE idx BETWEEN 1 AND 3")
def lrange(spark, d):
    return lists.lrange(user_events(spark, d), 1, 3)


@query(f"WITH {_L} SELECT key, pos, value, idx FROM l WHERE idx >= n - 3")
def lrange_tail(spark, d):
    return lists.lrange(user_events(spark, d), -3, -1)


@query(f"WITH {_L} SELECT key, value FROM l WHERE ridx = 1")
def lindex_negative(spark, d):
    return lists.lindex(user_events(spark, d), -2)


@query(f"WITH {_L} SELECT key, pos, value FROM l WHERE idx >= 2 AND ridx >= 1")
def ltrim(spark, d):
    return lists.ltrim(user_events(spark, d), 2, -2)


@query(f"WITH {_L}, h AS (SELECT key, idx, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS occurrence FROM l WHERE value = 'click') SELECT * FROM h WHERE occurrence BETWEEN 2 AND 3")
def lpos(spark, d):
    return lists.lpos(user_events(spark, d), "click", rank=-2, n=2)


@query(f"WITH {_L} SELECT key, pos, value FROM l QUALIFY NOT (value = 'view' AND row_number() OVER (PARTITION BY key, value ORDER BY pos) <= 2)")
def lrem(spark, d):
    return lists.lrem(user_events(spark, d), 2, "view")


@query(
    f"WITH {_L}, p AS (SELECT key, min(idx) AS p0 FROM l WHERE value = 'click' GROUP BY key) "
    "SELECT l.key, CAST(CASE WHEN p0 IS NOT NULL AND idx > p0 THEN idx + 1 ELSE idx END AS BIGINT) AS pos, value FROM l LEFT JOIN p USING (key) UNION ALL SELECT key, CAST(p0 + 1 AS BIGINT), 'inserted' FROM p"
)
def linsert(spark, d):
    return lists.linsert(user_events(spark, d), "click", "inserted", after=True)


@query(f"WITH {_L} SELECT key, pos, value, ridx AS idx FROM l WHERE ridx < 2")
def rpop(spark, d):
    return lists.pop(user_events(spark, d), 2, lists.RIGHT)[0]


@query(f"WITH {_L} SELECT key, pos, value FROM l WHERE idx >= 1")
def lpop_remainder(spark, d):
    return lists.pop(user_events(spark, d), 1)[1]


@query(
    f"WITH {_L}, mv AS (SELECT max(pos) AS p FROM l WHERE key = 1), lo AS (SELECT coalesce(min(pos) - 1, 0) AS q FROM l WHERE key = 2) "
    "SELECT CASE WHEN key = 1 AND pos = (SELECT p FROM mv) THEN 2 ELSE key END AS key, CASE WHEN key = 1 AND pos = (SELECT p FROM mv) THEN (SELECT q FROM lo) ELSE pos END AS pos, value FROM l"
)
def lmove(spark, d):
    return lists.lmove(user_events(spark, d), 1, 2).withColumn("key", F.col("key").cast("bigint"))


@query(f"WITH {_L} SELECT key, CASE WHEN idx = 0 THEN 'first' ELSE value END AS value, pos FROM l")
def lset(spark, d):
    return lists.lset(user_events(spark, d), 0, "first")


@query("WITH e AS (SELECT event_type AS key, event_id, user_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) SELECT key, CAST(-r AS BIGINT) AS pos, CAST(user_id AS VARCHAR) AS value FROM e")
def lpush(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("value"))
    empty = e.select("key", F.lit(0).cast("bigint").alias("pos"), "value").limit(0)
    return lists.push(empty, e, lists.LEFT)[0]


@query("SELECT user_id AS key, CAST(event_id AS VARCHAR) AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS idx, event_id AS pos FROM events QUALIFY idx < 5")
def sort_numeric_desc(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), F.col("event_id").cast("string").alias("value"))
    return sorting.sort(e, desc=True, limit=5)


@query(f"WITH {_M} SELECT key, CAST(member AS VARCHAR) AS member, row_number() OVER (PARTITION BY key ORDER BY CAST(member AS VARCHAR)) - 3 AS idx FROM m QUALIFY idx BETWEEN 0 AND 3")
def sort_alpha_limit(spark, d):
    m = flag_parts(spark, d).withColumn("member", F.col("member").cast("string"))
    return sorting.sort(m, "member", alpha=True, offset=2, limit=4)


# ---- strings ----------------------------------------------------------------------


@query("SELECT event_type AS key, event_id AS seq, CAST(1 AS BIGINT) AS delta, count(*) OVER (PARTITION BY event_type ORDER BY event_id) AS value FROM events")
def incr_running(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.lit(1).cast("bigint").alias("delta"))
    return strings.incr_running(e)


@query("SELECT p_partkey AS key, strlen(p_name) AS n, substr(p_name, 3, 4) AS part, substr(p_name, greatest(strlen(p_name) - 3, 0), 3) AS tail FROM part".replace("greatest(strlen(p_name) - 3, 0), 3", "greatest(strlen(p_name) - 3, 1), 3"))
def getrange(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), strings.strlen(name).alias("n"), strings.getrange(name, 2, 5).alias("part"), strings.getrange(name, -4, -2).alias("tail"))


@query("SELECT p_partkey AS key, substr(rpad(p_name, CAST(greatest(strlen(p_name), 5) AS INT), chr(0)), 1, 5) || 'XY' || substr(p_name, 8) AS value FROM part")
def setrange(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), strings.setrange(F.col("p_name"), 5, "XY").cast("string").alias("value"))


@query("SELECT user_id AS key, string_agg(substr(event_type, 1, 1), '' ORDER BY event_id) AS value FROM events GROUP BY user_id")
def append(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.substring("event_type", 1, 1).alias("value"))
    return strings.append(e.drop("seq").limit(0), e)


@query("SELECT event_id AS pos, user_id * 7 AS key, c_name AS value FROM events LEFT JOIN customer ON c_custkey = user_id * 7")
def mget(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    r = table(spark, d, "events").select(F.col("event_id").alias("pos"), (F.col("user_id") * 7).alias("key"))
    return strings.mget(s, r)


@query("SELECT user_id AS key, event_id AS seq, event_type AS value, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events")
def getset(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"))
    return strings.getset(e)


@query("SELECT c_custkey AS key, c_name AS value FROM customer UNION ALL SELECT user_id, arg_max(event_type, event_id) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer) GROUP BY 1".replace("arg_max", "arg_min"))
def setnx(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"))
    return strings.put(s, e, nx=True)


# ---- keys of any type -------------------------------------------------------------


@query("SELECT c_name AS key FROM customer WHERE regexp_full_match(c_name, '.*[13-5][^0]')")
def keys_glob(spark, d):
    return generic.keys(table(spark, d, "customer").select(F.col("c_name").alias("key")), "*[13-5][^0]")


@query(f"WITH {_K} SELECT key, expire_at_ms FROM k WHERE expire_at_ms = 0 OR expire_at_ms > {NOW_MS}")
def expire_live(spark, d):
    return live(order_keys(spark, d), NOW_MS).select("key", "expire_at_ms")


@query(f"WITH {_K} SELECT key, CAST(CASE WHEN expire_at_ms = 0 THEN -1 WHEN expire_at_ms <= {NOW_MS} THEN -2 ELSE (expire_at_ms - {NOW_MS} + 999) // 1000 END AS BIGINT) AS ttl, CAST(CASE WHEN expire_at_ms = 0 THEN -1 WHEN expire_at_ms <= {NOW_MS} THEN -2 ELSE expire_at_ms - {NOW_MS} END AS BIGINT) AS pttl FROM k")
def ttl(spark, d):
    at = F.col("expire_at_ms")
    return order_keys(spark, d).select("key", generic.ttl(at, NOW_MS).alias("ttl"), generic.ttl(at, NOW_MS, "ms").alias("pttl"))


@query(
    f"WITH {_K}, r AS (SELECT key, expire_at_ms, {NOW_MS} + (key % 5000 + 1) * 1000000 AS t0 FROM k WHERE expire_at_ms = 0 OR expire_at_ms > {NOW_MS}) "
    "SELECT key, CASE WHEN expire_at_ms <> 0 AND t0 > expire_at_ms THEN t0 ELSE expire_at_ms END AS expire_at_ms FROM r"
)
def expire_gt(spark, d):
    k = order_keys(spark, d)
    r = k.select("key", ((F.col("key") % 5000 + 1) * 1000).alias("amount"))
    return generic.expire(k, r, NOW_MS, condition="gt").select("key", "expire_at_ms")


@query(f"WITH {_K} SELECT key, CASE WHEN key % 2 = 0 THEN 0 ELSE expire_at_ms END AS expire_at_ms FROM k")
def persist(spark, d):
    k = order_keys(spark, d)
    return generic.persist(k, k.filter("key % 2 = 0").select("key")).select("key", "expire_at_ms")


@query("SELECT CASE WHEN o_orderkey % 10 = 0 THEN -o_orderkey ELSE o_orderkey END AS key, o_orderstatus AS value FROM orders")
def rename_many(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"))
    return generic.move_mapping(o, o.filter("key % 10 = 0").select("key", (-F.col("key")).alias("new_key")))


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events)")
def del_keys(spark, d):
    k = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    return generic.delete(k, table(spark, d, "events").select(F.col("event_id").alias("key")))


@query("SELECT count(*) AS n FROM events WHERE user_id IN (SELECT o_orderkey FROM orders)")
def exists_count(spark, d):
    k = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"))
    return generic.exists(k, table(spark, d, "events").select(F.col("user_id").alias("key")))


@query(f"WITH {_K} SELECT key, strlen(CAST(key AS VARCHAR)) + 48 + CASE WHEN expire_at_ms > 0 THEN strlen(CAST(key AS VARCHAR)) + 32 ELSE 0 END + 24 + strlen(o_orderpriority) AS bytes FROM k JOIN orders ON key = o_orderkey")
def memory_usage(spark, d):
    k = order_keys(spark, d).withColumn("key", F.col("key").cast("string"))
    s = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.lit("string").alias("kind"), F.octet_length("o_orderpriority").alias("bytes"), F.lit(1).alias("n"))
    return introspection.memory_usage(k, s).select(F.col("key").cast("bigint").alias("key"), "bytes")


@query(f"WITH {_M}, s AS (SELECT key, count(*) AS n FROM m GROUP BY key) SELECT key, CASE WHEN n <= 512 THEN 'intset' ELSE 'hashtable' END AS encoding FROM s".replace("WHEN n <= 512 THEN 'intset'", "WHEN n <= 512 THEN 'intset' WHEN n <= 128 THEN 'listpack'"))
def object_encoding(spark, d):
    m = flag_parts(spark, d).withColumn("member", F.col("member").cast("string"))
    return introspection.collection_encoding(introspection.collection_stats(m, "member"), "set").select("key", "encoding")


def _sized_keys(spark, d) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.max("event_id").alias("last_access_ms"), (F.count("*") * 100).alias("bytes"))
    return e.withColumn("freq", (F.col("bytes") / 100).cast("int")).withColumn("expire_at_ms", F.when(F.col("key") % 2 == 0, F.lit(NOW_MS) + F.col("key")).otherwise(F.lit(0)))


_EVICT = "e AS (SELECT user_id AS key, max(event_id) AS last, count(*) * 100 AS bytes FROM events GROUP BY 1)"


@query(f"WITH {_EVICT}, r AS (SELECT key, coalesce(sum(bytes) OVER (ORDER BY last, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, sum(bytes) OVER () AS total FROM e) SELECT key FROM r WHERE freed < total - 50000 + 1")
def evict_lru(spark, d):
    return eviction.evict(_sized_keys(spark, d), 50_000, "allkeys-lru")


@query(f"WITH {_EVICT}, t AS (SELECT sum(bytes) AS total FROM e), r AS (SELECT key, coalesce(sum(bytes) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM e WHERE key % 2 = 0) SELECT key FROM r, t WHERE freed < total - 70000 + 1")
def evict_volatile_ttl(spark, d):
    return eviction.evict(_sized_keys(spark, d), 70_000, "volatile-ttl")


@query(f"WITH {_K} SELECT key FROM k WHERE expire_at_ms <> 0 AND expire_at_ms <= {NOW_MS}")
def expiry_sweep(spark, d):
    return eviction.sweep(order_keys(spark, d), NOW_MS)


# ---- log and fold -----------------------------------------------------------------


def event_log(spark, d) -> DataFrame:
    """Effects: clicks set, views count, purchases add to a set, signups remove, logins are fields."""
    e = table(spark, d, "events")
    user, id_ = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    kind = F.pmod(F.col("event_id"), F.lit(8))
    verb = F.when(kind < 2, "SET").when(kind == 2, "INCRBY").when(kind < 5, "SADD").when(kind == 5, "SREM").otherwise("HSET")
    key = F.when(kind < 2, F.concat(F.lit("s:"), user)).when(kind == 2, F.concat(F.lit("c:"), user)).when(kind < 6, F.concat(F.lit("m:"), user)).otherwise(F.concat(F.lit("h:"), user))
    item = F.pmod(F.col("event_id") * 7, F.lit(5)).cast("string")
    args = F.when(kind < 2, F.array(key, id_)).when(kind == 2, F.array(key, F.lit("3"))).when(kind < 6, F.array(key, item)).otherwise(F.array(key, item, id_))
    args = F.transform(args, lambda a: a.cast("binary"))
    return e.select(F.col("event_id").alias("offset"), F.lit(0).alias("db"), verb.alias("verb"), args.alias("args"))


_LOG = "e AS (SELECT event_id AS i, user_id AS u, event_id % 8 AS k, (event_id * 7) % 5 AS item FROM events)"
_FOLD = f"""WITH {_LOG}
SELECT 's:' || u AS key, 'string' AS type, NULL AS field, CAST(max(i) AS VARCHAR) AS value FROM e WHERE k < 2 GROUP BY u
UNION ALL SELECT 'c:' || u, 'string', NULL, CAST(3 * count(*) AS VARCHAR) FROM e WHERE k = 2 GROUP BY u
UNION ALL SELECT 'm:' || u, 'set', CAST(item AS VARCHAR), NULL FROM e WHERE k BETWEEN 3 AND 5 GROUP BY u, item HAVING arg_max(k, i) < 5
UNION ALL SELECT 'h:' || u, 'hash', CAST(item AS VARCHAR), CAST(max(i) AS VARCHAR) FROM e WHERE k > 5 GROUP BY u, item"""


def _shown(elements: DataFrame) -> DataFrame:
    return elements.select(*[F.col(c).cast("string").alias(c) for c in ("key", "type", "field", "value")])


@query(_FOLD)
def fold_log(spark, d):
    return _shown(folds.fold(event_log(spark, d)))


@query(_FOLD)
def fold_ordered(spark, d):
    return _shown(folds.fold_ordered(folds.after_flushes(folds.split_keys(event_log(spark, d)))))


@query(_FOLD)
def snapshot_recovery(spark, d):
    """Half the log as a snapshot with per-shard anchors, and the rest: must equal the whole fold."""
    log = event_log(spark, d)
    last = log.agg(F.max("offset")).first()[0] or 0
    shards = 4
    anchors = spark.range(shards).select(F.lit(0).alias("db"), F.col("id").cast("int").alias("shard"), (F.lit(last // 2) + F.col("id") * 7).alias("offset"))
    keyed = snapshot.with_shard(log.withColumn("key", F.col("args")[0]), shards=shards)
    before = keyed.join(F.broadcast(anchors.withColumnRenamed("offset", "anchor")), ["db", "shard"]).filter("offset < anchor").select(*log.columns)
    return _shown(snapshot.recover(written(folds.fold(before), "snapshot"), log, anchors, shards))


# ---- publish and subscribe --------------------------------------------------------


def subscriptions(spark) -> DataFrame:
    rows = [(1, "channel", "click"), (1, "pattern", "c*"), (2, "pattern", "*"), (3, "pattern", "[p-v]*"), (3, "channel", "purchase")]
    return spark.createDataFrame(rows, "client bigint, kind string, name string")


@query(
    "SELECT event_id AS msg_id, CAST((event_type = 'click') AS INT) + CAST(event_type LIKE 'c%' AS INT) + 1 + CAST(regexp_full_match(event_type, '[p-v].*') AS INT) + CAST((event_type = 'purchase') AS INT) AS receivers FROM events"
)
def psubscribe_fanout(spark, d):
    messages = table(spark, d, "events").select(F.col("event_id").alias("msg_id"), F.col("event_type").alias("channel"))
    return pubsub.publish_counts(messages, subscriptions(spark))


@query("SELECT p_partkey AS key, CAST(p_retailprice AS DOUBLE) AS value, p_partkey % 7 AS whole FROM part")
def float_text(spark, d):
    """Number texts read back to the same number (texts differ between engines, values do not)."""
    p = table(spark, d, "part")
    back = scalars.parse_float(scalars.format_float(F.col("p_retailprice")))
    return p.select(F.col("p_partkey").alias("key"), back.alias("value"), scalars.parse_int(scalars.format_float((F.col("p_partkey") % 7).cast("double"))).alias("whole"))


@query("SELECT c_nationkey AS key, c_custkey AS member FROM customer")
def scan_all_pages(spark, d):
    """The pages of a scan hold every element once."""
    m = table(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("member"))
    pages = [common.page(m, "member", cursor, 4).drop("next_cursor") for cursor in range(4)]
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out
