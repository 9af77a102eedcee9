"""Sharding by histogram sort: exact counts refine the splitters, one exchange.

The key of a row is (hash of the text, hash of the id): equal texts stand
together, and a text that holds a third of all rows can still be cut.  Rounds
of probes count exact bytes below candidate boundaries; each round narrows
every splitter to one probe interval, until its count meets the tolerance.
A splitter is placed at a text's border if one lies within the tolerance, else
inside that text's rows.  Only counts of probes reach the driver: their number
depends on shards and probes, not on the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import unused, written

PROBES = 64
TOLERANCE = 0.002
LOW, HIGH = -(1 << 63), 1 << 63


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow rows of ``docs``: id, size, checksum and the two key hashes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.col(id_col)).alias("g"),
    )


def _interval(key: str, spans: list[tuple[int, int]]) -> Column:
    """Number of the probe interval of a key, over all spans; null outside."""
    out = F.lit(None).cast("long")
    for k, (lo, hi) in enumerate(spans):
        step = max(1, -(-(hi - lo) // PROBES))
        # Decimal arithmetic: differences of longs may not fit a long.
        at = F.expr(f"(cast({key} as decimal(20,0)) - cast('{lo}' as decimal(20,0))) div cast('{step}' as decimal(20,0))")
        out = F.when((F.col(key) >= lo) & (F.col(key) <= hi - 1), at + k * PROBES).otherwise(out)
    return out


def _count(rows: DataFrame, key: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Exact bytes and rows of every probe interval of the spans."""
    found = rows.select(_interval(key, spans).alias("i"), "size").filter("i is not null").groupBy("i").agg(F.sum("size"), F.count("*"))
    out = [(0, 0)] * (len(spans) * PROBES)
    for i, n, k in found.collect():  # at most shards x probes rows
        out[i] = (n, k)
    return out


def _refine(rows: DataFrame, key: str, goals: list[tuple[int, int, int, int]], slack: int) -> list[tuple[int, int, int]]:
    """Per goal ``(lo, hi, bytes below lo, target)``: ``(boundary, bytes below it, bytes of the key at it)``.

    The boundary is within ``slack`` of the target, or beside the one row across
    which the target falls (the nearer side), or it is the single key of several
    rows across which it falls: only then are bytes of the key given.
    """
    active = list(goals)
    done: dict[int, tuple[int, int, int]] = {}
    while len(done) < len(active):
        todo = [k for k in range(len(active)) if k not in done]
        spans = sorted({active[k][:2] for k in todo})
        counts = _count(rows, key, spans)
        for k in todo:
            lo, hi, below, target = active[k]
            first = spans.index((lo, hi)) * PROBES
            step = max(1, -(-(hi - lo) // PROBES))
            for p in range(PROBES):
                n, here = counts[first + p]
                a, b = lo + p * step, min(lo + (p + 1) * step, hi)
                if below + n >= target or b >= hi:
                    break
                below += n
            over, under = abs(below + n - target), abs(below - target)
            if min(over, under) <= slack or here <= 1:
                done[k] = (a, below, 0) if under <= over else (b, below + n, 0)
            elif b - a <= 1:
                done[k] = (a, below, n)
            else:
                active[k] = (a, b, below, target)
    return [done[k] for k in range(len(active))]


def splitters(rows: DataFrame, parts: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """``parts - 1`` ascending key boundaries; a row goes above those at or below its key."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = int(total / parts * tolerance)
    targets = [total * (k + 1) // parts for k in range(parts - 1)]
    out: list[tuple[int, int]] = []
    cut: dict[int, list[tuple[int, int, int, int]]] = {}
    for (h, below, here), target in zip(_refine(rows, "h", [(LOW, HIGH, 0, t) for t in targets], slack), targets):
        if here:
            cut.setdefault(h, []).append((LOW, HIGH, below, target))
        else:
            out.append((h, LOW))
    for h, goals in cut.items():  # texts too large for a shard's border to pass by
        out += [(h, g) for g, _, _ in _refine(rows.filter(F.col("h") == h), "g", goals, slack)]
    return sorted(out)


def _above(bounds: list[tuple[int, int]]) -> Column:
    """How many boundaries are at or below a row's key."""
    at = [((F.col("h") > h) | ((F.col("h") == h) & (F.col("g") >= g))).cast("int") for h, g in (((min(h, HIGH - 1), g) if h < HIGH else (HIGH - 1, HIGH - 1)) for h, g in bounds)]
    return reduce(lambda a, b: a + b, at, F.lit(0))


def shard(docs: DataFrame, shards: int = 8, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each row.

    Law ``bytes``: shards hold near-equal bytes (size: UTF-8 bytes plus one).
    Equal texts are neighbours in one shard unless a shard's border must fall
    among them.  Slots number a shard's rows from 0 in key order.  Null texts
    are empty ones; null ids and repeated rows are rows like any other; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = written(keyed(docs, id_col, text_col), "shard-keys")
    bounds = splitters(rows, shards, tolerance)
    # Finer cuts of the key space only number the rows in parallel; rows are exchanged here and never again.
    fine = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("shard", _above(bounds)).repartitionByRange(fine, "shard", "h", "g", "doc_id")
    dealt = dealt.sortWithinPartitions("shard", "h", "g", "doc_id", "text_crc32", "size")
    # A row's number in its partition, and above it the partition's.
    dealt = written(dealt.withColumn("place", F.monotonically_increasing_id()), "shards")
    dealt = dealt.withColumn("part", F.shiftright("place", 33))
    sizes = dealt.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most partitions plus shards rows, since ranges are contiguous: a proven broadcast bound.
    bases = sizes.select("shard", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = dealt.join(F.broadcast(bases), ["shard", "part"])
    slot = F.col("base") + F.col("place") - F.col("first")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_sharded(docs: DataFrame, out: str, shards: int = 8, tolerance: float = TOLERANCE) -> None:
    """Write the whole rows of ``docs``, partitioned by shard, as Parquet."""
    rows = written(keyed(docs), "shard-keys")
    bounds = splitters(rows, shards, tolerance)
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(text).alias("h"), F.xxhash64("doc_id").alias("g"))
    placed = keys.withColumn("shard", _above(bounds)).repartitionByRange("shard", "h", "g")
    name = unused(docs, "shard")
    placed.select("row.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(out)
