"""Where a command's keys stand and which categories it belongs to.

COMMAND COUNT, DOCS and GETKEYS, and what access rules are checked against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .registry import COMMANDS, Command, lookup

#: First key, last key (from the end if negative) and step, the
#: command's name being argument 0; commands on data that are not here have one key, at 1.
POSITIONS = {
    "MGET": (1, -1, 1),
    "MSET": (1, -1, 2),
    "MSETNX": (1, -1, 2),
    "LMOVE": (1, 2, 1),
    "RPOPLPUSH": (1, 2, 1),
    "SMOVE": (1, 2, 1),
    "SINTER": (1, -1, 1),
    "SUNION": (1, -1, 1),
    "SDIFF": (1, -1, 1),
    "SINTERSTORE": (1, -1, 1),
    "SUNIONSTORE": (1, -1, 1),
    "SDIFFSTORE": (1, -1, 1),
    "SINTERCARD": (2, -1, 1),
    "ZRANGESTORE": (1, 2, 1),
    "ZUNION": (2, -1, 1),
    "ZINTER": (2, -1, 1),
    "ZDIFF": (2, -1, 1),
    "ZINTERCARD": (2, -1, 1),
    "DEL": (1, -1, 1),
    "UNLINK": (1, -1, 1),
    "EXISTS": (1, -1, 1),
    "TOUCH": (1, -1, 1),
    "RENAME": (1, 2, 1),
    "RENAMENX": (1, 2, 1),
    "COPY": (1, 2, 1),
    "BLPOP": (1, -2, 1),
    "BRPOP": (1, -2, 1),
    "BLMOVE": (1, 2, 1),
    "BRPOPLPUSH": (1, 2, 1),
    "BZPOPMIN": (1, -2, 1),
    "BZPOPMAX": (1, -2, 1),
    "WATCH": (1, -1, 1),
}
#: Commands of the keyspace without keys.
KEYLESS = ("KEYS", "SCAN", "RANDOMKEY", "DBSIZE")
#: Commands of category fast; the others are slow.
FAST = """GET SETNX GETSET GETDEL GETEX MGET INCR DECR INCRBY DECRBY INCRBYFLOAT APPEND STRLEN
HSET HMSET HSETNX HGET HMGET HDEL HLEN HEXISTS HSTRLEN HINCRBY HINCRBYFLOAT
LPUSH RPUSH LPUSHX RPUSHX LPOP RPOP LLEN SADD SREM SCARD SISMEMBER SMISMEMBER SPOP SMOVE
ZADD ZINCRBY ZREM ZSCORE ZMSCORE ZCARD ZCOUNT ZLEXCOUNT ZRANK ZREVRANK ZPOPMIN ZPOPMAX
DEL UNLINK EXISTS TOUCH TYPE RENAMENX DBSIZE EXPIRE PEXPIRE EXPIREAT PEXPIREAT PERSIST TTL PTTL EXPIRETIME PEXPIRETIME
MULTI DISCARD WATCH UNWATCH SUBSCRIBE PSUBSCRIBE UNSUBSCRIBE PUNSUBSCRIBE PUBLISH LASTSAVE
PING ECHO SELECT AUTH HELLO QUIT RESET TIME""".split()
#: Groups of commands and the category each gives.
CATEGORY = {"strings": "string", "hashes": "hash", "lists": "list", "sets": "set", "zsets": "sortedset", "keys": "keyspace", "transactions": "transaction", "pubsub": "pubsub", "connection": "connection", "replication": "admin", "persistence": "admin", "server": "admin"}
#: Commands whose categories do not follow from group and effect.
SPECIAL = {
    "SWAPDB": ("keyspace", "dangerous"),
    "SORT": ("write", "list", "set", "sortedset", "slow", "dangerous"),
    "SORT_RO": ("read", "list", "set", "sortedset", "slow", "dangerous"),
    "FLUSHDB": ("keyspace", "write", "slow", "dangerous"),
    "FLUSHALL": ("keyspace", "write", "slow", "dangerous"),
    "KEYS": ("keyspace", "read", "slow", "dangerous"),
    "INFO": ("slow", "dangerous"),
    "COMMAND": ("slow", "connection"),
    "WAIT": ("slow", "connection"),
    "MEMORY": ("admin", "slow"),
    "OBJECT": ("read", "slow"),
    "CLUSTER": ("slow",),
    "TIME": ("fast",),
}
_DATA = ("strings", "hashes", "lists", "sets", "zsets", "keys")


def categories(command: Command) -> tuple[str, ...]:
    """The access categories of a command."""
    if command.name in SPECIAL:
        return SPECIAL[command.name]
    pace = "fast" if command.name in FAST else "slow"
    if command.group == "blocking":
        return ("write", "sortedset" if command.name.startswith("BZ") else "list", pace, "blocking")
    own = CATEGORY[command.group]
    if command.group in _DATA:
        return (own, "read" if command.effect == "none" else "write", pace)
    return (own, pace, "dangerous") if own == "admin" else (own, pace)


def positions(command: Command) -> tuple[int, int, int] | None:
    """First key, last key and step; None if the command has no keys."""
    if command.name in POSITIONS:
        return POSITIONS[command.name]
    return (1, 1, 1) if command.group in _DATA and command.name not in KEYLESS else None


def get_keys(verb: str, args: list) -> list:
    """COMMAND GETKEYS of one command; ``args`` are without its name."""
    at = positions(lookup(verb))
    if at is None:
        raise ValueError("The command has no key arguments")
    first, last, step = at
    stop = min(last if last >= 0 else len(args) + 1 + last, len(args))
    out = args[first - 1 : stop : step]
    if not out:
        raise ValueError("The command has no key arguments")
    return out


def key_args(verb: Column, args: Column) -> Column:
    """COMMAND GETKEYS of every row: the key arguments; empty for commands without keys, and for unknown ones."""
    out = F.slice(args, 1, 0)
    groups: dict[tuple[int, int, int], list[str]] = {}
    for c in COMMANDS.values():
        if at := positions(c):
            groups.setdefault(at, []).append(c.name)
    n = F.size(args)
    for (first, last, step), names in groups.items():
        stop = F.least(F.lit(last) if last >= 0 else n + 1 + last, n)
        some = F.filter(args, lambda _, i: (i >= first - 1) & (i < stop) & ((i - (first - 1)) % step == 0))
        out = F.when(F.upper(verb).isin(names), some).otherwise(out)
    return out


def docs(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """COMMAND DOCS, and ACL CAT: name, group, categories and key positions of each command; unknown names have no row."""
    wanted = COMMANDS.values() if names is None else [COMMANDS[n.upper()] for n in names if n.upper() in COMMANDS]
    rows = [(c.name.lower(), c.group, list(categories(c)), *(positions(c) or (0, 0, 0))) for c in wanted]
    return spark.createDataFrame(rows, "name string, `group` string, categories array<string>, first_key int, last_key int, step int")


def count() -> int:
    """COMMAND COUNT."""
    return len(COMMANDS)
