"""Normal form of a keyspace: one narrow table per value type, and a key table.

Keys and members are BINARY in stored tables, whose order is unsigned bytewise;
every operator also takes STRING columns, which order the same for UTF-8.
"""

from pyspark.sql import types as T

DATABASES = 16

K = "db int, key binary, type string, expire_at_ms bigint, last_access_ms bigint, freq int, version bigint"
S = "db int, key binary, value binary"
L = "db int, key binary, pos bigint, value binary"
H = "db int, key binary, field binary, value binary"
M = "db int, key binary, member binary"
Z = "db int, key binary, member binary, score double"
LOG = "offset bigint, db int, verb string, args array<binary>"
ANCHORS = "db int, shard int, offset bigint"
SUBSCRIPTIONS = "client bigint, kind string, name string"
TABLES = {"string": S, "list": L, "hash": H, "set": M, "zset": Z}
TYPES = tuple(TABLES)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
