"""What a server answers about itself, over tables: configuration, slow commands, memory, clients, replicas, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.patterns import glob_regex
from ..functions.scalars import parse_memory
from ..operators.eviction import POLICIES, sweep
from ..operators.introspection import info
from .snapshot import recover

#: Directives with data semantics and their defaults; any other is kept as text.
DEFAULTS = {
    "active-expire": "yes",
    "databases": "16",
    "shards": "16",
    "hash-max-listpack-entries": "128",
    "hash-max-listpack-value": "64",
    "maxmemory": "0",
    "maxmemory-policy": "noeviction",
    "slowlog-log-slower-than": "10000",
    "slowlog-max-len": "128",
}
#: Directives that cannot change while state exists.
FIXED = ("databases", "shards")


def _checked(name: str, value: str) -> str:
    if name == "maxmemory":
        return str(parse_memory(value))
    if name == "maxmemory-policy" and value not in POLICIES:
        raise ValueError(f"CONFIG SET failed - unknown policy {value!r}")
    if name == "active-expire" and value not in ("yes", "no"):
        raise ValueError(f"CONFIG SET failed - {name} is yes or no")
    if DEFAULTS.get(name, "x").lstrip("-").isdigit() and not value.lstrip("-").isdigit():
        raise ValueError(f"CONFIG SET failed - {name} is a number")
    return value


def config_get(spark: SparkSession, config: dict[str, str], patterns: list[str]) -> DataFrame:
    """CONFIG GET: each directive that any pattern matches, once."""
    rows = sorted((DEFAULTS | config).items())
    table = spark.createDataFrame(rows, "name string, value string")
    return table.filter(F.col("name").rlike("|".join(f"(?:{glob_regex(p.lower())})" for p in patterns) or "(?!)"))


def config_set(config: dict[str, str], changes: dict[str, str]) -> dict[str, str]:
    """CONFIG SET: all changes or none."""
    new = {}
    for name, value in changes.items():
        name = name.lower()
        if name not in DEFAULTS and name not in config:
            raise ValueError(f"CONFIG SET failed - unknown directive {name!r}")
        if name in FIXED:
            raise ValueError(f"CONFIG SET failed - {name} cannot change")
        new[name] = _checked(name, str(value))
    return config | new


def since_reset(commands: DataFrame, reset_id: int) -> DataFrame:
    """CONFIG RESETSTAT, SLOWLOG RESET: what counts after a reset at a command's id."""
    return commands.filter(F.col("id") > reset_id)


def slowlog_len(commands: DataFrame, threshold_us: int = 10_000, max_len: int = 128) -> DataFrame:
    """SLOWLOG LEN: the ring keeps its last entries only."""
    return commands.filter(F.col("micros") >= threshold_us).agg(F.least(F.count("*"), F.lit(max_len)).alias("n"))


def memory_doctor(usage: DataFrame, maxmemory: int) -> DataFrame:
    """MEMORY DOCTOR: ``advice`` of the sum of ``bytes``: no-limit, near-limit (nine tenths or more) or none."""
    total = F.coalesce(F.sum("bytes"), F.lit(0))
    advice = F.when(F.lit(maxmemory) == 0, "no-limit").when(total * 10 >= F.lit(maxmemory) * 9, "near-limit").otherwise("none")
    return usage.agg(total.alias("bytes"), advice.alias("advice"))


def debug_object(encodings: DataFrame, usage: DataFrame, on: list[str]) -> DataFrame:
    """DEBUG OBJECT: encoding and size of each key."""
    return encodings.select(*on, "encoding").join(usage.select(*on, F.col("bytes").alias("serializedlength")), on).withColumn("refcount", F.lit(1))


def expire_cycle(k: DataFrame, now_ms: int, config: dict[str, str] | None = None) -> DataFrame:
    """DEBUG EXPIRE-CYCLE; with a configuration, the active cycle, which DEBUG SET-ACTIVE-EXPIRE 0 turns off."""
    on = (DEFAULTS | (config or {}))["active-expire"] == "yes"
    return sweep(k, now_ms) if on or config is None else sweep(k, now_ms).limit(0)


def cluster_info(spark: SparkSession) -> DataFrame:
    """CLUSTER INFO: there is no cluster; CLUSTER SLOTS and SHARDS are therefore empty, and no key is in a slot."""
    rows = [("cluster_enabled", "0"), ("cluster_state", "ok"), ("cluster_slots_assigned", "0"), ("cluster_known_nodes", "1"), ("cluster_size", "0")]
    return spark.createDataFrame(rows, "name string, value string")


def client_set(sessions: DataFrame, client: int, **changes: object) -> DataFrame:
    """CLIENT SETNAME, NO-EVICT, NO-TOUCH: set columns (``name``, ``no_evict``, ``no_touch``) of one session."""
    name = changes.get("name")
    if isinstance(name, str) and any(c <= " " or c > "~" for c in name):
        raise ValueError("Client names cannot contain spaces, newlines or special characters.")
    mine = F.col("id") == client
    types = dict(sessions.dtypes)
    return sessions.withColumns({c: F.when(mine, F.lit(v).cast(types[c])).otherwise(F.col(c)) for c, v in changes.items()})


def client_info(sessions: DataFrame, client: int) -> DataFrame:
    """CLIENT ID, GETNAME, INFO: the row of one session."""
    return sessions.filter(F.col("id") == client)


def touched(accesses: DataFrame, sessions: DataFrame) -> DataFrame:
    """Accesses that count for eviction: those of sessions without NO-TOUCH; the sessions are a counted, narrow table."""
    quiet = sessions.filter("no_touch").select(F.col("id").alias("client"))
    return accesses.join(quiet, "client", "left_anti")


def wait(log: DataFrame, acks: DataFrame, replicas: int) -> DataFrame:
    """WAIT: how many replicas have the log up to its end now, and whether that is enough.

    ``acks``: ``replica, offset`` (the next one it expects), several rows a
    replica; the furthest counts.  The target is read once: later records do not move it.
    """
    target = log.agg((F.coalesce(F.max("offset"), F.lit(-1)) + 1).alias("target"))
    last = acks.groupBy("replica").agg(F.max("offset").alias("acked"))
    # One row.
    both = last.join(F.broadcast(target), how="right")
    out = both.groupBy("target").agg(F.count_if(F.col("acked") >= F.col("target")).alias("acked"))
    return out.withColumn("enough", F.col("acked") >= replicas)


def sync_kind(log: DataFrame, same_history: bool, offset: int | None) -> str:
    """PSYNC: ``continue`` if the replica follows this history and the log still has its offset, else ``full``."""
    first, last = log.agg(F.min("offset"), F.max("offset")).first()
    known = same_history and offset is not None and first is not None and first <= offset <= last + 1
    return "continue" if known else "full"


def full_sync(snapshot: DataFrame, log: DataFrame, anchors: DataFrame) -> DataFrame:
    """A replica's first state: the leader's snapshot, then its log from the shards' anchors on."""
    return recover(snapshot, log, anchors)


def info_sections(k: DataFrame, commands: DataFrame, config: dict[str, str], now_ms: int, sections: list[str] | None = None) -> DataFrame:
    """INFO as ``section, name, value`` rows: memory, stats, keyspace and commandstats; none named means all."""
    spark = k.sparkSession
    config = DEFAULTS | config
    keys = info(k, now_ms)
    db = F.col("db").cast("string") if "db" in keys.columns else F.lit("0")
    per_db = keys.groupBy(db.alias("db")).agg(F.sum("keys").alias("keys"), F.sum("expires").alias("expires"))
    line = lambda *parts: F.concat_ws(",", *(F.concat(F.lit(f"{n}="), F.col(c).cast("string")) for n, c in parts))
    keyspace = per_db.select(F.lit("keyspace").alias("section"), F.concat(F.lit("db"), "db").alias("name"), line(("keys", "keys"), ("expires", "expires")).alias("value"))
    stats = commands.groupBy(F.lower("command").alias("command")).agg(F.count("*").alias("calls"), F.sum("micros").alias("usec"), F.count_if("failed").alias("failed"))
    per_command = stats.select(F.lit("commandstats").alias("section"), F.concat(F.lit("cmdstat_"), "command").alias("name"), line(("calls", "calls"), ("usec", "usec"), ("failed_calls", "failed")).alias("value"))
    total = commands.agg(F.count("*").cast("string").alias("value")).select(F.lit("stats").alias("section"), F.lit("total_commands_processed").alias("name"), "value")
    memory = spark.createDataFrame([("memory", n, config[n]) for n in ("maxmemory", "maxmemory-policy")], "section string, name string, value string")
    out = memory.unionByName(total).unionByName(keyspace).unionByName(per_command)
    return out if not sections else out.filter(F.col("section").isin([s.lower() for s in sections]))


def metrics(info_rows: DataFrame, prefix: str = "keyloom") -> DataFrame:
    """Metrics text: a line a value of ``info_sections`` rows; values that are lists of pairs give a line a pair."""
    pairs = F.transform(F.split("value", ","), lambda x: F.when(x.contains("="), F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("k"), F.split_part(x, F.lit("="), F.lit(2)).alias("v"))).otherwise(F.struct(F.lit("").alias("k"), x.alias("v"))))
    each = info_rows.select("section", "name", F.explode(pairs).alias("p")).filter(F.col("p.v").rlike(r"^-?[0-9]+(\.[0-9]+)?$"))
    listed = F.col("p.k") != ""
    name = F.when(listed, F.concat_ws("_", F.lit(prefix), "section", "p.k")).otherwise(F.concat_ws("_", F.lit(prefix), F.regexp_replace("name", "[^a-zA-Z0-9_]", "_")))
    label: Column = F.when(listed, F.concat(F.lit('{name="'), F.regexp_replace("name", r'(["\\])', r"\\$1"), F.lit('"}'))).otherwise("")
    return each.select(F.concat(name, label, F.lit(" "), F.col("p.v")).alias("line"))

