"""Snapshots with per-shard anchors, recovery, and log compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import shard_of
from ..sources import segments
from .fold import fold_split, split_keys

SHARDS = 16


def with_shard(df: DataFrame, key: str = "key", shards: int = SHARDS) -> DataFrame:
    return df.withColumn("shard", shard_of(F.col(key), shards))


def _commits(spark: SparkSession, path: str) -> list:
    """The latest commit of a snapshot folder, if it has one."""
    if not segments.exists(spark, f"{path}/commits"):
        return []
    return spark.read.parquet(f"{path}/commits").orderBy(F.desc("generation")).limit(1).collect()


def save(elements: DataFrame, anchors: DataFrame, path: str, shards: int = SHARDS, now_ms: int = 0) -> int:
    """SAVE, BGSAVE: elements by database and shard, and the offset each shard's copy stands at; its generation.

    Each generation has folders of its own, and one row written after them
    makes it the snapshot: until then, and if the job dies, readers see the one
    before.  A snapshot without anchors is an error.
    """
    spark = elements.sparkSession
    lo, hi = anchors.agg(F.min("offset"), F.max("offset")).first()
    if lo is None:
        raise ValueError("a snapshot needs anchors")
    done = _commits(spark, path)
    generation = done[0]["generation"] + 1 if done else 1
    at = f"{path}/{generation}"
    with_shard(elements, shards=shards).write.mode("overwrite").partitionBy("db", "shard").parquet(f"{at}/elements")
    anchors.write.mode("overwrite").parquet(f"{at}/anchors")
    spark.createDataFrame([(generation, lo, hi, now_ms)], "generation bigint, first bigint, last bigint, at_ms bigint").coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return generation


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Elements and anchors of the last committed snapshot."""
    done = _commits(spark, path)
    if not done:
        raise ValueError(f"no committed snapshot in {path}")
    at = f"{path}/{done[0]['generation']}"
    return spark.read.parquet(f"{at}/elements"), spark.read.parquet(f"{at}/anchors")


def lastsave(spark: SparkSession, path: str) -> int:
    """LASTSAVE: when the last committed snapshot was taken, in seconds; 0 if there is none."""
    done = _commits(spark, path)
    return done[0]["at_ms"] // 1000 if done else 0


def rewrite(spark: SparkSession, log_path: str, path: str) -> list[int]:
    """BGREWRITEAOF: delete log segments wholly below every anchor of the committed snapshot, and older generations; the segments."""
    done = _commits(spark, path)
    if not done:
        return []
    for old in range(1, done[0]["generation"]):
        segments.delete(spark, f"{path}/{old}")
    return segments.prune(spark, log_path, done[0]["first"])


def suffix(log: DataFrame, anchors: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Records the snapshot of their shard does not hold yet, split by key.

    At most databases x shards anchors: a fixed bound, so they are broadcast.
    """
    rows = split_keys(log)
    flush = rows.filter("key is null")
    keyed = with_shard(rows.filter("key is not null"), shards=shards)
    kept = keyed.join(F.broadcast(anchors.withColumnRenamed("offset", "anchor")), ["db", "shard"], "left")
    kept = kept.filter("anchor is null or offset >= anchor").drop("anchor", "shard")
    first = anchors.agg(F.min("offset").alias("anchor"))
    late = flush.join(F.broadcast(first)).filter("offset >= coalesce(anchor, -1)").drop("anchor")
    return kept.unionByName(late.select(*kept.columns))


def rebuild_records(elements: DataFrame) -> DataFrame:
    """A snapshot as log records that precede every offset."""
    order = F.coalesce(F.col("pos"), F.lit(0))
    verb = F.expr("CASE type WHEN 'string' THEN 'SET' WHEN 'hash' THEN 'HSET' WHEN 'set' THEN 'SADD' WHEN 'zset' THEN 'ZADD' ELSE 'RPUSH' END")
    score = F.col("score").cast("string").cast("binary")
    args = (
        F.when(F.col("type") == "hash", F.array("field", "value"))
        .when(F.col("type") == "set", F.array("field"))
        .when(F.col("type") == "zset", F.array(score, F.col("field")))
        .otherwise(F.array("value"))
    )
    low = F.lit(-(1 << 62))
    rows = elements.select((low + order).alias("offset"), "db", verb.alias("verb"), F.lit(0).cast("bigint").alias("sub"), "key", args.alias("args"))
    stamps = elements.filter("expire_at_ms > 0").select("db", "key", "expire_at_ms").distinct()
    stamps = stamps.select(F.lit(-2).cast("bigint").alias("offset"), "db", F.lit("PEXPIREAT").alias("verb"), F.lit(0).cast("bigint").alias("sub"), "key", F.array(F.col("expire_at_ms").cast("string").cast("binary")).alias("args"))
    return rows.unionByName(stamps)


def recover(snapshot: DataFrame, log: DataFrame, anchors: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Snapshot and log suffix folded: the elements a full fold of the log would give."""
    check_flushes(log, anchors)
    rows = rebuild_records(snapshot).unionByName(suffix(log, anchors, shards))
    return fold_split(rows)


def check_flushes(log: DataFrame, anchors: DataFrame) -> None:
    """Refuse anchors that a flush or SWAPDB lies between: what of it the shards hold is not one state."""
    lo, hi = anchors.agg(F.min("offset"), F.max("offset")).first()
    if lo is None:
        return
    between = log.filter(F.upper("verb").isin("FLUSHDB", "FLUSHALL", "SWAPDB") & (F.col("offset") >= lo) & (F.col("offset") < hi))
    if not between.isEmpty():
        raise ValueError(f"a record on a whole database lies between the snapshot's anchors {lo} and {hi}")


def check_gap(log: DataFrame, anchors: DataFrame) -> None:
    """Refuse a log that begins after the snapshot or ends before it, or anchors on both sides of a flush."""
    first, last = log.agg(F.min("offset"), F.max("offset")).first()
    lo, hi = anchors.agg(F.min("offset"), F.max("offset")).first()
    if first is not None and lo is not None and (first > lo or last + 1 < hi):
        raise ValueError(f"log covers {first} to {last}, the snapshot needs {lo} to {hi}")
    check_flushes(log, anchors)


def compact(bounds: DataFrame, anchors: DataFrame) -> DataFrame:
    """Which segments (``segment, first, last``) are wholly below every anchor and may be dropped."""
    low = anchors.agg(F.min("offset")).first()[0]
    return bounds.filter(F.col("last") < (low if low is not None else -(1 << 62)))


def snapshot_due(now_s: int, last_s: int, log_bytes: int, base_bytes: int, interval_s: int = 3600, percentage: int = 100, min_bytes: int = 64 << 20) -> bool:
    """Whether a snapshot is due by time or by log growth."""
    grown = log_bytes >= min_bytes and log_bytes >= base_bytes * (1 + percentage / 100)
    return interval_s > 0 and now_s - last_s >= interval_s or percentage > 0 and grown
