"""Expiry sweeps and memory limits as exact, set-based jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import by, running, seeded
from .live import expired

POLICIES = ("noeviction", "allkeys-lru", "volatile-lru", "allkeys-lfu", "volatile-lfu", "allkeys-random", "volatile-random", "volatile-ttl")
#: Ranges of the rank that partial sums are taken over.
RANGES = 1024
#: How often the range that holds the cut is cut again.
PASSES = 3


def sweep(k: DataFrame, now_ms: int) -> DataFrame:
    """The keys an expiry pass deletes (all that have expired, not a sample)."""
    return k.filter(expired(F.col("expire_at_ms"), now_ms)).select(*by(k))


def rank(policy: str, seed: int | str = 0) -> Column:
    """What is evicted first has the lowest rank; a key that was never accessed comes first."""
    if policy.endswith("lru"):
        return F.col("last_access_ms").cast("double")
    if policy.endswith("lfu"):
        return F.col("freq").cast("double")
    if policy.endswith("ttl"):
        return F.col("expire_at_ms").cast("double")
    return F.conv(F.substring(seeded(F.col("key"), seed), 1, 12), 16, 10).cast("double")


def evict(k: DataFrame, maxmemory: int, policy: str = "allkeys-lru", seed: int | str = 0, replica: bool = False) -> DataFrame:
    """The keys to evict until the sum of ``bytes`` is below ``maxmemory``.

    Sums of rank ranges (a bounded number) find the range that holds the cut,
    which is cut again until its width is spent: what lies below goes whole.
    Only the last range takes a running total, and that in many tasks, so
    neither ranks close together nor equal ones gather in one.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    if policy == "noeviction" or replica:
        return k.limit(0).select(*by(k))
    pool = k.filter(F.coalesce("expire_at_ms", F.lit(0)) > 0) if policy.startswith("volatile") else k
    total = k.agg(F.sum("bytes")).first()[0] or 0
    excess = total - maxmemory + 1  # down to below the limit
    if excess <= 0:
        return k.limit(0).select(*by(k))
    ranked = pool.select(*by(k), "bytes", F.coalesce(rank(policy, seed), F.lit(0.0)).alias("rank"))
    ends = ranked.agg(F.min("rank"), F.max("rank")).first()
    lo, hi, freed = (ends[0] or 0.0), (ends[1] or 0.0), 0
    inside, below = F.lit(True), F.lit(False)
    for _ in range(PASSES):
        width = (hi - lo) / RANGES
        if width <= 0 or lo + width == lo:
            break
        place = F.greatest(F.lit(0), F.least(F.floor((F.col("rank") - lo) / width), F.lit(RANGES - 1)))
        sums = dict(ranked.filter(inside).groupBy(place.alias("range")).agg(F.sum("bytes")).collect())  # RANGES rows at most
        cut = None
        for r in sorted(sums):
            if freed + sums[r] >= excess:
                cut = r
                break
            freed += sums[r]
        if cut is None:  # all of the pool is not enough
            return ranked.select(*by(k))
        inside, below = inside & (place == cut), below | (inside & (place < cut))
        lo, hi = lo + cut * width, lo + (cut + 1) * width
    last = running(ranked.filter(inside).select(F.lit(0).alias("db"), F.lit(0).alias("key"), "rank", "bytes", F.struct(*by(k)).alias("id")), [F.col("rank"), F.col("id")], "freed", F.col("bytes"), before=True)
    return ranked.filter(below).select(*by(k)).unionByName(last.filter(F.col("freed") + F.lit(freed) < excess).select("id.*"))


def access_counters(accesses: DataFrame, now_ms: int, start: int = 5) -> DataFrame:
    """LFU counters from an access log ``key, at_ms``: start plus accesses, less a minute's decay each."""
    key = by(accesses)
    out = accesses.groupBy(*key).agg(F.count("*").alias("hits"), F.max("at_ms").alias("last"))
    decay = F.floor((F.lit(now_ms) - F.col("last")) / 60_000)
    return out.select(*key, F.greatest(F.least(F.col("hits") - 1 + start, F.lit(255)) - decay, F.lit(0)).cast("int").alias("freq"))
