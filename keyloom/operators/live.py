"""The one place where expiry is decided, and typed access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LEADER, REPLICA, LOADING = "leader", "replica", "loading"


class WrongType(ValueError):
    """The key holds another kind of value."""

    def __init__(self) -> None:
        super().__init__("WRONGTYPE Operation against a key holding the wrong kind of value")


def expired(expire_at_ms: Column, now_ms: int, mode: str = LEADER) -> Column:
    """Whether an instant has passed; the instant itself is dead, 0 never expires, nothing does while loading."""
    if mode == LOADING:
        return F.lit(False)
    at = F.coalesce(expire_at_ms, F.lit(0))
    return (at != 0) & (at <= F.lit(now_ms))


def live(keys: DataFrame, now_ms: int, mode: str = LEADER) -> DataFrame:
    """The keys that have not expired at ``now_ms``."""
    return keys.filter(~expired(F.col("expire_at_ms"), now_ms, mode))


def visible(table: DataFrame, keys: DataFrame, now_ms: int, mode: str = LEADER) -> DataFrame:
    """Rows of a value table whose key is live."""
    return table.join(live(keys, now_ms, mode).select("db", "key"), ["db", "key"], "left_semi")


def typed(keys: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """``wanted`` (``db, key``) with ``status``: ok, missing or wrongtype."""
    found = wanted.join(keys.select("db", "key", "type"), ["db", "key"], "left")
    status = F.when(F.col("type").isNull(), "missing").when(F.col("type") == kind, "ok").otherwise("wrongtype")
    return found.withColumn("status", status).drop("type")
