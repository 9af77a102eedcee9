"""Publish and subscribe as joins of messages with a subscription table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.patterns import glob, glob_regex

#: Distinct patterns whose expressions are unrolled into one plan; more are matched in several.
PATTERNS = 500


def deliveries(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One row a delivery: a client that k subscriptions match gets k.

    Exact channels are an equality join.  Patterns are matched against the
    distinct channels of the batch first, not against every message, and
    channels then join by equality too.
    """
    exact = messages.join(subscriptions.filter("kind = 'channel'").select("client", F.col("name").alias("channel")), "channel").withColumn("pattern", F.lit(None).cast("string"))
    matched = pattern_channels(messages.select("channel").distinct(), subscriptions)
    return exact.unionByName(messages.join(matched, "channel").select(*exact.columns))


def pattern_channels(channels: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``channel, client, pattern`` for every pattern subscription that matches."""
    pats = subscriptions.filter("kind = 'pattern'").select("client", F.col("name").alias("pattern"))
    names = sorted(r.pattern for r in pats.select("pattern").distinct().collect())
    empty = F.array().cast("array<string>")
    found = channels.withColumn("pattern", F.explode(empty))
    for at in range(0, len(names), PATTERNS):
        tests = [F.when(F.col("channel").rlike(glob_regex(p)), F.array(F.lit(p))).otherwise(empty) for p in names[at : at + PATTERNS]]
        some = channels.withColumn("pattern", F.explode(F.concat(*tests)))
        found = found.unionByName(some) if at else some
    return found.join(pats, "pattern").select("channel", "client", "pattern")


def publish_counts(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """PUBLISH replies: deliveries of each message (0 too)."""
    n = deliveries(messages, subscriptions).groupBy("msg_id").agg(F.count("*").alias("receivers"))
    return messages.select("msg_id").join(n, "msg_id", "left").withColumn("receivers", F.coalesce("receivers", F.lit(0)))


def subscribe(subscriptions: DataFrame, new: DataFrame) -> DataFrame:
    """SUBSCRIBE, PSUBSCRIBE: ``new`` is ``client, kind, name``."""
    return subscriptions.unionByName(new).distinct()


def unsubscribe(subscriptions: DataFrame, client: int, kind: str, names: list[str] | None = None) -> DataFrame:
    """UNSUBSCRIBE, PUNSUBSCRIBE: no names means all."""
    mine = (F.col("client") == client) & (F.col("kind") == kind)
    return subscriptions.filter(~mine if names is None else ~(mine & F.col("name").isin(names)))


def channels(subscriptions: DataFrame, pattern: str | None = None) -> DataFrame:
    """PUBSUB CHANNELS."""
    out = subscriptions.filter("kind = 'channel'").select("name").distinct()
    return out if pattern is None else out.filter(glob(F.col("name"), pattern))


def numsub(subscriptions: DataFrame, wanted: DataFrame) -> DataFrame:
    """PUBSUB NUMSUB of ``name`` rows."""
    n = subscriptions.filter("kind = 'channel'").groupBy("name").agg(F.countDistinct("client").alias("n"))
    return wanted.join(n, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def numpat(subscriptions: DataFrame) -> DataFrame:
    """PUBSUB NUMPAT: distinct patterns."""
    return subscriptions.filter("kind = 'pattern'").agg(F.countDistinct("name").alias("n"))
