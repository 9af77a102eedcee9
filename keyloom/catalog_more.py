"""More registered queries: keys of any type, remaining command forms, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from .catalog import _F, _H, _K, _L, _LEX, _M, _Z, NOW_MS, customer_requests, customers, flag_parts, order_counts, order_fields, order_keys, part_names, query, user_events
from .operators import eviction, generic, hashes, introspection, lists, pubsub, sets, sorting, strings, zsets
from .plans import access, effects, positions, registry, server
from .sources import wire
from .sources.readers import table
from .sources.shared import shared_folder
from .streaming import jobs


@query(f"WITH {_Z} SELECT key, count(*) AS n FROM z GROUP BY key")
def zcard(spark, d):
    return zsets.zcard(customers(spark, d))


@query(
    f"WITH {_Z}, k AS (SELECT key, member, score, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank FROM z), "
    "r AS (SELECT c_mktsegment AS key, 'Customer#' || printf('%09d', c_custkey * 2) AS member FROM customer) SELECT r.key, r.member, k.score, k.rank FROM r LEFT JOIN k USING (key, member)"
)
def zrank_of(spark, d):
    """One request for every customer."""
    return zsets.zrank_of(customers(spark, d), customer_requests(spark, d))


@query(f"WITH {_Z} SELECT key, member, score FROM z WHERE member NOT LIKE '%7'")
def zrem(spark, d):
    z = customers(spark, d)
    return zsets.zrem(z, z.filter("member LIKE '%7'").select("key", "member"))


@query(f"WITH {_Z}, t AS (SELECT 'top' AS key, member, score FROM z WHERE key = 'BUILDING' QUALIFY row_number() OVER (ORDER BY score DESC, member DESC) <= 10) SELECT key, member, score FROM z UNION ALL SELECT * FROM t")
def zrangestore(spark, d):
    z = customers(spark, d)
    return zsets.zrangestore(z, "top", zsets.zrange(z.filter("key = 'BUILDING'"), 0, 9, rev=True))


@query(f"WITH {_F} SELECT 'both' AS key, member, f.score * o.score / o.score + o.score * 3 AS score FROM f JOIN o USING (member)")
def zinterstore_weighted(spark, d):
    base = order_counts(spark, d, "P").withColumn("key", F.lit("both")).limit(0)
    return zsets.zstore(base, "both", zsets.zinter(order_counts(spark, d, "F"), order_counts(spark, d, "O"), weights=[1, 3])).select("key", "member", "score")


@query(f"WITH {_LEX} SELECT key, member, CAST(score AS DOUBLE) AS score FROM z WHERE member >= 'd' AND member <= 'p' QUALIFY row_number() OVER (PARTITION BY key ORDER BY member DESC) BETWEEN 2 AND 3")
def zrevrangebylex(spark, d):
    return zsets.zrangebylex(part_names(spark, d), "[d", "[p", rev=True, offset=1, limit=2)


@query(f"WITH {_M}, s AS (SELECT member FROM m WHERE key = 'A' INTERSECT SELECT member FROM m WHERE key = 'N') SELECT key, member FROM m UNION ALL SELECT 'AN', member FROM s")
def sinterstore(spark, d):
    m = flag_parts(spark, d)
    return sets.sstore(m, "AN", sets.sinter(sets.members(m, "A"), sets.members(m, "N")))


@query("SELECT o_custkey AS key, array_to_string(list_sort(list(o_orderkey)), ',') AS members FROM orders GROUP BY o_custkey")
def smembers(spark, d):
    """Customer -> orders, sets that are small by nature: every member of every key."""
    m = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("member"))
    return sets.smembers(m).select("key", F.concat_ws(",", F.transform("members", lambda x: x.cast("string"))).alias("members"))


@query(f"WITH {_M} SELECT key, member FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY md5('5' || member), member) <= 4")
def srandmember_seeded(spark, d):
    return sets.srandmember(flag_parts(spark, d), 4, seed=5)


@query(f"WITH {_H} SELECT key, value FROM h")
def hvals(spark, d):
    return hashes.hvals(order_fields(spark, d))


@query(f"WITH {_H} SELECT o_orderkey * 3 AS key, 'cents' AS field, CAST(o_orderkey * 3 IN (SELECT o_orderkey FROM orders) AS INT) AS found FROM orders".replace(f"WITH {_H} ", ""))
def hexists(spark, d):
    r = table(spark, d, "orders").select((F.col("o_orderkey") * 3).alias("key"), F.lit("cents").alias("field"))
    return hashes.hexists(order_fields(spark, d), r)


@query("SELECT user_id AS key, event_type AS field, sum(event_id * 0.5) AS value FROM events GROUP BY ALL".replace("sum(event_id * 0.5)", "sum(CAST(event_id AS DOUBLE) * 0.5)"))
def hincrbyfloat(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.col("event_id").alias("seq"), (F.col("event_id") * 0.5).alias("delta"))
    out = hashes.hincrbyfloat(e.select("key", "field", F.lit("0").alias("value")).limit(0), e)
    return out.withColumn("value", F.col("value").cast("double"))


@query("SELECT event_type AS key, sum(CAST(event_id AS DOUBLE) * 0.25) AS value FROM events GROUP BY ALL")
def incrbyfloat(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") * 0.25).alias("delta"))
    return strings.incrbyfloat(e.select("key", F.lit("0").alias("value")).limit(0), e).withColumn("value", F.col("value").cast("double"))


@query("SELECT event_type AS key, CAST(sum(event_id) AS VARCHAR) AS value FROM events GROUP BY ALL")
def incrby(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("delta"))
    return strings.incrby(e.select("key", F.lit("0").alias("value")).limit(0), e)


@query(f"WITH {_L} SELECT key, count(*) AS n FROM l GROUP BY key")
def llen(spark, d):
    return lists.llen(user_events(spark, d))


@query(f"WITH {_L}, h AS (SELECT key, idx, row_number() OVER (PARTITION BY key ORDER BY idx) AS occurrence FROM l WHERE value = 'view' AND idx < 20) SELECT * FROM h")
def lpos_maxlen(spark, d):
    return lists.lpos(user_events(spark, d), "view", n=0, maxlen=20)


@query(f"WITH {_L}, s AS (SELECT value, row_number() OVER (ORDER BY value DESC, pos) - 1 AS pos FROM l WHERE key = 1) SELECT -1 AS key, CAST(pos AS BIGINT) AS pos, value FROM s UNION ALL SELECT key, pos, value FROM l")
def sort_store(spark, d):
    l = user_events(spark, d)
    return sorting.sort_store(l, -1, sorting.sort(l.filter("key = 1"), alpha=True, desc=True)).withColumn("key", F.col("key").cast("bigint"))


@query("SELECT p_partkey AS key, strlen(p_name) AS n FROM part")
def strlen(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), strings.strlen(F.col("p_name")).alias("n"))


@query(f"WITH {_K}, r AS (SELECT event_id * 3 AS key FROM events) SELECT key, CASE WHEN key IN (SELECT key FROM k) THEN 'hash' ELSE 'none' END AS type FROM r")
def type_of(spark, d):
    return generic.type_of(order_keys(spark, d), table(spark, d, "events").select((F.col("event_id") * 3).alias("key")))


@query(f"WITH {_K} SELECT count(*) AS n FROM k WHERE expire_at_ms = 0 OR expire_at_ms > {NOW_MS}")
def dbsize(spark, d):
    return generic.dbsize(order_keys(spark, d), NOW_MS)


@query(f"WITH {_K} SELECT key, CAST(CASE WHEN expire_at_ms = 0 THEN -1 WHEN expire_at_ms <= {NOW_MS} THEN -2 ELSE (expire_at_ms + 999) // 1000 END AS BIGINT) AS expiretime, CAST(CASE WHEN expire_at_ms = 0 THEN -1 WHEN expire_at_ms <= {NOW_MS} THEN -2 ELSE expire_at_ms END AS BIGINT) AS pexpiretime FROM k")
def expiretime(spark, d):
    at = F.col("expire_at_ms")
    return order_keys(spark, d).select("key", generic.expiretime(at, NOW_MS).alias("expiretime"), generic.expiretime(at, NOW_MS, "ms").alias("pexpiretime"))


@query("SELECT o_orderkey AS key, o_orderstatus AS value FROM orders WHERE o_orderkey <> 2 UNION ALL SELECT 2, o_orderstatus FROM orders WHERE o_orderkey = 1")
def copy_replace(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"))
    return generic.copy(o, 1, 2).withColumn("key", F.col("key").cast("bigint"))


@query("SELECT CASE c_nationkey WHEN 3 THEN 4 WHEN 4 THEN 3 ELSE c_nationkey END AS db, c_custkey AS key FROM customer")
def swapdb(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("db"), F.col("c_custkey").alias("key"))
    return generic.swapdb(c, 3, 4)


@query("SELECT c_nationkey AS db, c_custkey AS key FROM customer WHERE c_nationkey <> 7")
def flushdb(spark, d):
    return generic.flush(table(spark, d, "customer").select(F.col("c_nationkey").alias("db"), F.col("c_custkey").alias("key")), 7)


@query(f"WITH {_K} SELECT 'hash' AS type, count(*) AS keys, count(*) FILTER (expire_at_ms > 0) AS expires FROM k WHERE expire_at_ms = 0 OR expire_at_ms > {NOW_MS}")
def info_keyspace(spark, d):
    return introspection.info(order_keys(spark, d), NOW_MS).select("type", "keys", "expires")


@query("SELECT c_name AS key FROM customer WHERE c_name LIKE '%01' OR c_name LIKE 'Customer#00000002_'")
def acl_keys(spark, d):
    return introspection.acl_keys(table(spark, d, "customer").select(F.col("c_name").alias("key")), ["*01", "Customer#00000002?"])


@query("SELECT user_id AS key, CAST(least(count(*) + 4, 255) AS INT) AS freq FROM events GROUP BY user_id")
def lfu_counters(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.lit(NOW_MS).alias("at_ms"))
    return eviction.access_counters(e, NOW_MS)


@query("SELECT event_type AS name, count(DISTINCT user_id) AS n FROM events GROUP BY 1 UNION ALL SELECT 'silent', 0")
def pubsub_numsub(spark, d):
    e = table(spark, d, "events")
    subs = e.select(F.col("user_id").alias("client"), F.lit("channel").alias("kind"), F.col("event_type").alias("name"))
    wanted = e.select(F.col("event_type").alias("name")).distinct().unionByName(spark.createDataFrame([("silent",)], "name string"))
    return pubsub.numsub(subs, wanted)


@query("WITH w AS (SELECT user_id AS txn, min(event_id) AS seen, max(event_id) AS last FROM events GROUP BY 1) SELECT txn, seen AS \"offset\" FROM w WHERE seen = last")
def watch_exec(spark, d):
    """Transactions that watch their user's key at its first effect run only if no later effect touched it."""
    e = table(spark, d, "events")
    log = e.select(F.col("event_id").alias("offset"), F.lit(0).alias("db"), F.lit("INCRBY").alias("verb"), F.array(F.col("user_id").cast("string").cast("binary")).alias("args"))
    w = e.groupBy(F.col("user_id").alias("txn")).agg(F.min("event_id").alias("offset"))
    watched = w.select("txn", F.lit(0).alias("db"), F.col("txn").cast("string").cast("binary").alias("key"), F.col("offset").alias("seen"))
    return effects.transaction(w, watched, log)


@query()
def command_table(spark, d):
    """COMMAND: the catalog of commands (not in the data, so without an oracle)."""
    return registry.frame(spark)


def _stream(spark, d, ddl: str) -> DataFrame:
    """The events as a log directory that a stream tails."""
    at = f"{shared_folder(spark)}/keyloom/events-{uuid.uuid4().hex}"
    table(spark, d, "events").select("event_id", "user_id", "event_type").write.parquet(at)
    return jobs.tail(spark, at, ddl)


def _run(df: DataFrame, mode: str) -> DataFrame:
    name = f"stream_{uuid.uuid4().hex}"
    return jobs.run_to_table(df, name, mode)


@query("SELECT event_type AS key, CAST(count(*) AS BIGINT) AS value, count(*) AS n FROM events GROUP BY event_type")
def stream_counters(spark, d):
    s = _stream(spark, d, "event_id bigint, user_id bigint, event_type string").select(F.col("event_type").alias("key"), F.lit(1).cast("bigint").alias("delta"))
    return _run(jobs.counters(s, "key", "delta"), "complete")


@query("SELECT user_id AS key, arg_max(event_type, event_id) AS value, max(event_id) AS version FROM events GROUP BY user_id")
def stream_last_writes(spark, d):
    s = _stream(spark, d, "event_id bigint, user_id bigint, event_type string").withColumnRenamed("user_id", "key")
    return _run(jobs.last_writes(s, "key", "event_type", "event_id").withColumnRenamed("event_type", "value"), "complete")


@query(
    "WITH e AS (SELECT CAST(user_id % 50 AS VARCHAR) AS queue, event_id, event_id % 2 AS pop, row_number() OVER (PARTITION BY user_id % 50, event_id % 2 ORDER BY event_id) AS k FROM events) "
    "SELECT a.queue, a.event_id AS client, CAST(b.event_id AS VARCHAR) AS value, a.event_id AS seq FROM e a JOIN e b ON a.queue = b.queue AND a.k = b.k AND a.pop = 1 AND b.pop = 0"
)
def stream_blocking_pops(spark, d):
    """BLPOP without deadlines: the k-th pop of a queue is served the k-th push."""
    s = _stream(spark, d, "event_id bigint, user_id bigint, event_type string")
    pop = F.col("event_id") % 2 == 1
    s = s.select(
        (F.col("user_id") % 50).cast("string").alias("queue"), F.col("event_id").alias("seq"), F.col("event_id").alias("at_ms"), F.when(pop, "pop").otherwise("push").alias("kind"),
        F.col("event_id").alias("client"), F.col("event_id").cast("string").alias("value"), F.lit(0).cast("bigint").alias("deadline_ms"),
    )
    return _run(jobs.blocking_pops(s), "append").drop("score")


@query("SELECT CAST(user_id AS VARCHAR) AS queue, max(event_id) AS client, CAST(max(event_id) AS VARCHAR) AS value, CAST(max(event_id) AS DOUBLE) AS score, max(event_id) + 1 AS seq FROM events GROUP BY user_id")
def stream_bzpopmax(spark, d):
    """BZPOPMAX: a pop that waits behind every user's events takes the member of the highest score."""
    s = _stream(spark, d, "event_id bigint, user_id bigint, event_type string")
    zero = F.lit(0).cast("bigint")
    none = F.lit(None).cast("string")
    push = F.struct(F.col("event_id").alias("seq"), F.lit("push").alias("kind"), zero.alias("client"), F.col("event_id").cast("string").alias("value"), F.col("event_id").cast("double").alias("score"), none.alias("side"))
    last = _last_of_each(spark, d)
    pop = F.struct((F.col("event_id") + 1).alias("seq"), F.lit("pop").alias("kind"), F.col("event_id").alias("client"), none.alias("value"), F.lit(None).cast("double").alias("score"), F.lit("max").alias("side"))
    rows = s.join(last, ["user_id"]).withColumn("row", F.explode(F.when(F.col("event_id") == F.col("last"), F.array(push, pop)).otherwise(F.array(push))))
    rows = rows.select(F.col("user_id").cast("string").alias("queue"), "row.*").withColumn("at_ms", F.col("seq")).withColumn("deadline_ms", zero)
    return _run(jobs.blocking_pops(rows), "append")


def _last_of_each(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("last"))


# ---- access and server tables -------------------------------------------------------


def _commands(spark, d) -> DataFrame:
    """Events as commands: each type is a verb, every seventh a DEL, on keys of users."""
    e = table(spark, d, "events")
    verb = F.create_map(*(F.lit(x) for x in ("click", "GET", "view", "MGET", "purchase", "SET", "signup", "MSET")))
    own, other = F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.concat(F.lit("user:"), (F.col("event_id") % 97).cast("string"))
    args = F.array(own, other, other)
    return e.select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 3 == 0, "reader").when(F.col("user_id") % 3 == 1, "writer").otherwise("stranger").alias("user"), F.when(F.col("event_id") % 7 == 0, "DEL").otherwise(F.coalesce(verb[F.col("event_type")], F.lit("PUBLISH"))).alias("verb"), args.alias("args"))


_CMD = (
    "c AS (SELECT event_id AS id, CASE user_id % 3 WHEN 0 THEN 'reader' WHEN 1 THEN 'writer' ELSE 'stranger' END AS user, "
    "CASE WHEN event_id % 7 = 0 THEN 'DEL' ELSE CASE event_type WHEN 'click' THEN 'GET' WHEN 'view' THEN 'MGET' WHEN 'purchase' THEN 'SET' WHEN 'signup' THEN 'MSET' ELSE 'PUBLISH' END END AS verb, "
    "'user:' || user_id AS own, 'user:' || (event_id % 97) AS other FROM events)"
)


@query(
    f"WITH {_CMD}, k AS (SELECT *, CASE verb WHEN 'GET' THEN [own] WHEN 'SET' THEN [own] WHEN 'MGET' THEN [own, other, other] WHEN 'MSET' THEN [own, other] WHEN 'DEL' THEN [own, other, other] ELSE [] END AS keys FROM c) "
    "SELECT id, CASE WHEN user = 'stranger' THEN 'user' WHEN user = 'reader' AND verb NOT IN ('GET', 'MGET') OR user = 'writer' AND verb = 'DEL' THEN 'command' "
    "WHEN user = 'reader' AND len([x for x in keys if NOT regexp_matches(x, '^user:.*[0-4]$')]) > 0 THEN 'key' "
    "WHEN user = 'writer' AND verb = 'PUBLISH' AND NOT regexp_matches(own, '^user:1') THEN 'channel' END AS denied FROM k"
)
def acl_decide(spark, d):
    """ACL: which of the commands of all users may run."""
    users = access.set_user(access.open_users(), "reader", ["on", "nopass", "~user:*[0-4]", "+@read"])
    users = access.set_user(users, "writer", ["on", "nopass", "~*", "&user:1*", "+@all", "-del"])
    return access.decide(_commands(spark, d), users).select("id", "denied")


@query(f"WITH {_CMD} SELECT id, CASE verb WHEN 'GET' THEN own WHEN 'SET' THEN own WHEN 'MGET' THEN own || ',' || other || ',' || other WHEN 'MSET' THEN own || ',' || other WHEN 'DEL' THEN own || ',' || other || ',' || other ELSE '' END AS keys FROM c")
def command_getkeys(spark, d):
    return _commands(spark, d).select("id", F.array_join(positions.key_args(F.col("verb"), F.col("args")), ",").alias("keys"))


@query(f"WITH {_CMD} SELECT id, '*4' || chr(13) || chr(10) || '$' || strlen(verb) || chr(13) || chr(10) || verb || chr(13) || chr(10) || '$' || strlen(own) || chr(13) || chr(10) || own || chr(13) || chr(10) || '$' || strlen(other) || chr(13) || chr(10) || other || chr(13) || chr(10) || '$' || strlen(other) || chr(13) || chr(10) || other || chr(13) || chr(10) AS request FROM c")
def wire_requests(spark, d):
    """Commands as the bytes of requests."""
    return _commands(spark, d).select("id", wire.reply_bytes(F.concat(F.array("verb"), F.col("args")), "array").cast("string").alias("request"))


def _timed(spark, d) -> DataFrame:
    return _commands(spark, d).select("id", F.col("verb").alias("command"), (F.col("id") % 30_000).alias("micros"), (F.col("id") % 11 == 0).alias("failed"))


@query(f"WITH {_CMD} SELECT CAST(least(count(*), 128) AS BIGINT) AS n FROM c WHERE id % 30000 >= 2000 AND id > 100")
def slowlog_len(spark, d):
    """SLOWLOG LEN after a reset at command 100."""
    return server.slowlog_len(server.since_reset(_timed(spark, d), 100), 2000)


@query(
    f"WITH {_CMD}, k AS (SELECT o_orderkey % 16 AS db, o_orderkey FROM orders), s AS (SELECT lower(verb) AS command, count(*) AS calls, CAST(sum(id % 30000) AS BIGINT) AS usec, count(*) FILTER (WHERE id % 11 = 0) AS failed FROM c GROUP BY 1) "
    "SELECT 'memory' AS section, 'maxmemory' AS name, '1048576' AS value UNION ALL SELECT 'memory', 'maxmemory-policy', 'allkeys-lru' UNION ALL SELECT 'stats', 'total_commands_processed', CAST(count(*) AS VARCHAR) FROM c "
    "UNION ALL SELECT 'keyspace', 'db' || db, 'keys=' || count(*) || ',expires=0' FROM k GROUP BY db UNION ALL SELECT 'commandstats', 'cmdstat_' || command, 'calls=' || calls || ',usec=' || usec || ',failed_calls=' || failed FROM s"
)
def info_sections(spark, d):
    k = table(spark, d, "orders").select((F.col("o_orderkey") % 16).alias("db"), F.col("o_orderkey").alias("key"), F.lit("hash").alias("type"), F.lit(0).cast("bigint").alias("expire_at_ms"))
    config = server.config_set({}, {"maxmemory": "1m", "maxmemory-policy": "allkeys-lru"})
    return server.info_sections(k, _timed(spark, d), config, NOW_MS)


@query("WITH a AS (SELECT user_id % 5 AS replica, max(event_id) + 1 AS acked FROM events GROUP BY 1), t AS (SELECT max(event_id) + 1 AS target FROM events) SELECT target, count(*) FILTER (WHERE acked >= target) AS acked, count(*) FILTER (WHERE acked >= target) >= 1 AS enough FROM a, t GROUP BY target")
def wait_quorum(spark, d):
    """WAIT 1: replicas, of five, that have acknowledged the whole log."""
    e = table(spark, d, "events")
    acks = e.select((F.col("user_id") % 5).alias("replica"), (F.col("event_id") + 1).alias("offset"))
    return server.wait(e.select(F.col("event_id").alias("offset")), acks, 1)


@query(
    "WITH t AS (SELECT event_id, CAST(100 AS BIGINT) + row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS value FROM events) SELECT event_type AS key, event_id AS seq, CAST(1 AS BIGINT) AS delta, t.value FROM events JOIN t USING (event_id)"
)
def incr_stored(spark, d):
    """INCR replies from stored values: every counter stands at 100."""
    e = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.lit(1).cast("bigint").alias("delta"))
    stored = e.select("key").distinct().withColumn("value", F.lit("100"))
    return strings.incr_running(e, s=stored)
