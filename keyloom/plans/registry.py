"""Every command of the surface: its group, effect kind, locality and operator.

``effect``: none, verbatim (arguments replay safely) or canonical (logged as a
rewrite).  ``target``: the function that serves it, or a reason why a library
over tables has none.
"""

from __future__ import annotations

import importlib
from dataclasses import dataclass

NONE, VERBATIM, CANONICAL = "none", "verbatim", "canonical"
WIRE = "out of scope: wire protocol or server process"

#: One line a command: name, effect, cross-shard (x) or not (-), target.
_LINES = """
strings
GET none - strings.get
SET canonical - effects.set_effects
SETNX canonical - strings.put
SETEX canonical - effects.set_effects
PSETEX canonical - effects.set_effects
GETSET canonical - strings.getset
GETDEL canonical - strings.getdel
GETEX canonical - generic.expire
MGET none - strings.mget
MSET verbatim - strings.put
MSETNX canonical x strings.msetnx
INCR verbatim - strings.incr_running
DECR verbatim - strings.incr_running
INCRBY verbatim - strings.incrby
DECRBY verbatim - strings.incrby
INCRBYFLOAT canonical - strings.incrbyfloat
APPEND verbatim - strings.append
STRLEN none - strings.strlen
GETRANGE none - strings.getrange
SETRANGE verbatim - strings.setrange
SUBSTR none - strings.getrange
hashes
HSET verbatim - hashes.hset
HMSET verbatim - hashes.hset
HSETNX canonical - hashes.hsetnx
HGET none - hashes.hget
HMGET none - hashes.hget
HDEL verbatim - hashes.hdel
HLEN none - hashes.hlen
HEXISTS none - hashes.hexists
HSTRLEN none - hashes.hstrlen
HKEYS none - hashes.hkeys
HVALS none - hashes.hvals
HGETALL none - hashes.hgetall
HINCRBY verbatim - hashes.hincrby
HINCRBYFLOAT canonical - hashes.hincrbyfloat
HRANDFIELD none - hashes.hrandfield
HSCAN none - hashes.hscan
lists
LPUSH verbatim - lists.push
RPUSH verbatim - lists.push
LPUSHX verbatim - lists.push
RPUSHX verbatim - lists.push
LPOP verbatim - lists.pop
RPOP verbatim - lists.pop
LLEN none - lists.llen
LINDEX none - lists.lindex
LSET verbatim - lists.lset
LRANGE none - lists.lrange
LINSERT verbatim - lists.linsert
LREM verbatim - lists.lrem
LTRIM verbatim - lists.ltrim
LPOS none - lists.lpos
LMOVE verbatim x lists.lmove
RPOPLPUSH verbatim x lists.lmove
sets
SADD verbatim - sets.sadd
SREM verbatim - sets.srem
SCARD none - sets.scard
SISMEMBER none - sets.smismember
SMISMEMBER none - sets.smismember
SMEMBERS none - sets.smembers
SPOP canonical - sets.spop
SRANDMEMBER none - sets.srandmember
SMOVE verbatim x sets.smove
SINTER none - sets.sinter
SUNION none - sets.sunion
SDIFF none - sets.sdiff
SINTERSTORE verbatim x sets.sstore
SUNIONSTORE verbatim x sets.sstore
SDIFFSTORE verbatim x sets.sstore
SINTERCARD none - sets.sintercard
SSCAN none - sets.sscan
zsets
ZADD canonical - zsets.zadd
ZINCRBY canonical - zsets.zincrby
ZREM verbatim - zsets.zrem
ZSCORE none - zsets.zscore
ZMSCORE none - zsets.zscore
ZCARD none - zsets.zcard
ZCOUNT none - zsets.zcount
ZLEXCOUNT none - zsets.zlexcount
ZRANGE none - zsets.zrange
ZREVRANGE none - zsets.zrange
ZRANGEBYSCORE none - zsets.zrangebyscore
ZREVRANGEBYSCORE none - zsets.zrangebyscore
ZRANGEBYLEX none - zsets.zrangebylex
ZREVRANGEBYLEX none - zsets.zrangebylex
ZRANGESTORE verbatim x zsets.zrangestore
ZRANK none - zsets.zrank
ZREVRANK none - zsets.zrank
ZPOPMIN canonical - zsets.zpop
ZPOPMAX canonical - zsets.zpop
ZREMRANGEBYRANK verbatim - zsets.zremrangebyrank
ZREMRANGEBYSCORE verbatim - zsets.zremrangebyscore
ZREMRANGEBYLEX verbatim - zsets.zremrangebylex
ZUNION none - zsets.zunion
ZINTER none - zsets.zinter
ZDIFF none - zsets.zdiff
ZUNIONSTORE verbatim x zsets.zstore
ZINTERSTORE verbatim x zsets.zstore
ZDIFFSTORE verbatim x zsets.zstore
ZINTERCARD none - zsets.zintercard
ZRANDMEMBER none - zsets.zrandmember
ZSCAN none - zsets.zscan
keys
DEL verbatim - generic.delete
UNLINK verbatim - generic.delete
EXISTS none - generic.exists
TOUCH none - generic.touch
TYPE none - generic.type_of
RENAME verbatim x generic.rename
RENAMENX canonical x generic.renamenx_allowed
COPY canonical x generic.copy
KEYS none - generic.keys
SCAN none - generic.scan
RANDOMKEY none - sets.randomkey
DBSIZE none - generic.dbsize
EXPIRE canonical - generic.expire
PEXPIRE canonical - generic.expire
EXPIREAT canonical - generic.expire
PEXPIREAT canonical - generic.expire
PERSIST verbatim - generic.persist
TTL none - generic.ttl
PTTL none - generic.ttl
EXPIRETIME none - generic.expiretime
PEXPIRETIME none - generic.expiretime
SORT verbatim x sorting.sort
SORT_RO none - sorting.sort
blocking
BLPOP canonical - jobs.blocking_pops
BRPOP canonical - jobs.blocking_pops
BLMOVE canonical x jobs.blocking_pops
BRPOPLPUSH canonical x jobs.blocking_pops
BZPOPMIN canonical - jobs.blocking_pops
BZPOPMAX canonical - jobs.blocking_pops
transactions
MULTI none - jobs.transactions
EXEC none - effects.transaction
DISCARD none - effects.transaction
WATCH none - effects.transaction
UNWATCH none - effects.transaction
pubsub
SUBSCRIBE none - pubsub.subscribe
PSUBSCRIBE none - pubsub.subscribe
UNSUBSCRIBE none - pubsub.unsubscribe
PUNSUBSCRIBE none - pubsub.unsubscribe
PUBLISH none - pubsub.publish_counts
PUBSUB none - pubsub.channels
replication
REPLICAOF none - jobs.follow
SLAVEOF none - jobs.follow
REPLCONF none - !wire
PSYNC none - server.sync_kind
WAIT none - server.wait
persistence
SAVE none - snapshot.save
BGSAVE none - snapshot.save
BGREWRITEAOF none - snapshot.rewrite
LASTSAVE none - snapshot.lastsave
connection
PING none - !wire
ECHO none - !wire
SELECT none - !wire
SWAPDB verbatim x generic.swapdb
AUTH none - access.User
HELLO none - !wire
QUIT none - !wire
RESET none - !wire
CLIENT none - introspection.clients
server
COMMAND none - registry.frame
CONFIG none - server.config_set
INFO none - server.info_sections
FLUSHDB canonical x generic.flush
FLUSHALL canonical x generic.flush
TIME none - !wire
SHUTDOWN none - !wire
SLOWLOG none - introspection.slowlog
MEMORY none - introspection.memory_usage
OBJECT none - introspection.collection_encoding
DEBUG none - server.expire_cycle
MONITOR none - jobs.tail
ACL none - access.decide
CLUSTER none - server.cluster_info
"""
#: Commands that are refused by decision.
REFUSED = "EVAL EVALSHA EVAL_RO EVALSHA_RO SCRIPT FUNCTION FCALL FCALL_RO XADD XREAD XRANGE XLEN XINFO XGROUP DUMP RESTORE MIGRATE FAILOVER PFADD PFCOUNT PFMERGE BITFIELD LCS LATENCY SSUBSCRIBE SUNSUBSCRIBE SPUBLISH".split()
_PLACES = {"effects": "plans", "snapshot": "plans", "registry": "plans", "server": "plans", "access": "plans", "positions": "plans", "jobs": "streaming", "readers": "sources"}


@dataclass(frozen=True)
class Command:
    name: str
    group: str
    effect: str
    cross_shard: bool
    target: str

    @property
    def in_scope(self) -> bool:
        return not self.target.startswith("!")

    def function(self):
        """The operator that serves the command."""
        module, name = self.target.split(".")
        return getattr(importlib.import_module(f"keyloom.{_PLACES.get(module, 'operators')}.{module}"), name)


def _parse() -> dict[str, Command]:
    out, group = {}, ""
    for line in _LINES.split("\n"):
        words = line.split()
        if len(words) == 1:
            group = words[0]
        elif words:
            name, effect, across, target = words
            out[name] = Command(name, group, effect, across == "x", target)
    return out


COMMANDS = _parse()


def lookup(name: str) -> Command:
    """A command by name; refused and unknown ones are errors that say so."""
    upper = name.upper()
    if upper in REFUSED:
        raise NotImplementedError(f"{upper} is refused by decision")
    if upper not in COMMANDS:
        raise KeyError(f"unknown command {name!r}")
    return COMMANDS[upper]


def frame(spark):
    """COMMAND as a DataFrame."""
    rows = [(c.name, c.group, c.effect, c.cross_shard, c.target if c.in_scope else WIRE) for c in COMMANDS.values()]
    return spark.createDataFrame(rows, "name string, `group` string, effect string, cross_shard boolean, target string")
