"""Structured Streaming over the effect log: folds, sweeps, fan-out, blocking pops, replicas."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schema
from ..operators.pubsub import deliveries
from ..sources.shared import shared_folder


def tail(spark: SparkSession, path: str, ddl: str = schema.LOG, files: int | None = None) -> DataFrame:
    """The log as a stream: new files are new records; the checkpoint is the offset."""
    reader = spark.readStream.schema(schema.struct(ddl))
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def follow(stream: DataFrame, out: str, checkpoint: str):
    """Replica: append the leader's records to an own log, exactly once."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(stream: DataFrame, key: str, delta: str) -> DataFrame:
    """INCR counters as a running aggregate (complete or update mode)."""
    return stream.groupBy(key).agg(F.sum(delta).alias("value"), F.count("*").alias("n"))


def last_writes(stream: DataFrame, key: str, value: str, offset: str) -> DataFrame:
    """SET as a running aggregate: the last write of each key."""
    return stream.groupBy(key).agg(F.max_by(value, offset).alias("value"), F.max(offset).alias("version"))


def publish(stream: DataFrame, subscriptions: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """PUBLISH fan-out of each micro-batch."""

    def batch(df: DataFrame, epoch: int) -> None:
        sink(deliveries(df, subscriptions), epoch)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def transactions(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """MULTI/EXEC: a micro-batch is an epoch; its effects become visible together."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


POPS = "queue string, client bigint, value string, score double, seq bigint"


def _taken(values: list[tuple], side: str) -> tuple:
    """Take one value out: the tail, the lowest or highest (score, then bytes), or the head."""
    at = 0
    if side == "right":
        at = len(values) - 1
    elif side in ("min", "max"):
        ranked = sorted(range(len(values)), key=lambda i: (values[i][1], values[i][0].encode()))
        at = ranked[0 if side == "min" else -1]
    return values.pop(at)


def match_pops(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, timers: bool = False) -> Iterator[pd.DataFrame]:
    """One queue: pushes meet waiting pops, first come first served.

    Rows: ``seq, at_ms, kind (push, pop), client, value, score, deadline_ms,
    side``; state holds values not popped and pops not served.  A pop past its
    deadline gets a null value, at a later row's ``at_ms`` or by a timer, where
    the stream has event time.  Within a batch rows apply in ``seq`` order.
    """
    values, waiting = ([tuple(x) for x in part] for part in state.get) if state.exists else ([], [])
    out = []

    def late(now: int) -> None:
        for w in [w for w in waiting if 0 < w[1] <= now]:
            waiting.remove(w)
            out.append((key[0], w[0], None, None, w[2]))

    timed = state.hasTimedOut
    if timed:
        late(state.getCurrentWatermarkMs())
    rows = [] if timed else pd.concat(list(batches)).sort_values("seq").itertuples()
    for r in rows:
        late(r.at_ms)
        if r.kind == "push":
            score = 0.0 if pd.isna(r.score) else float(r.score)
            if r.scored:  # a member has one score, the last one given
                values[:] = [v for v in values if v[0] != r.value]
            values.append((r.value, score))
        else:
            waiting.append((int(r.client), int(r.deadline_ms), int(r.seq), r.side))
        while values and waiting:
            client, _, seq, side = waiting.pop(0)
            value, score = _taken(values, side)
            out.append((key[0], client, value, score if side in ("min", "max") else None, seq))
    if values or waiting:
        state.update((values, waiting))
        due = [w[1] for w in waiting if w[1] > 0]
        if due and timers:
            state.setTimeoutTimestamp(max(min(due), state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()
    if not out:
        return
    yield pd.DataFrame({"queue": [x[0] for x in out], "client": pd.array([x[1] for x in out], "Int64"), "value": [x[2] for x in out], "score": pd.array([x[3] for x in out], "Float64"), "seq": pd.array([x[4] for x in out], "Int64")})


def match_pops_by_time(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """``match_pops`` with a timer at the next deadline."""
    return match_pops(key, batches, state, timers=True)


def blocking_pops(stream: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """BLPOP, BRPOP, BLMOVE, BRPOPLPUSH, BZPOPMIN, BZPOPMAX over ``queue, seq, at_ms, kind, client, value, deadline_ms``.

    An optional ``side`` of a pop is the end it takes from: left (if absent or
    null), right for BRPOP and BRPOPLPUSH, min or max for sorted sets, whose
    pushes have a ``score``.  First come first served by ``seq``.  With a
    timestamp column ``ts`` deadlines (in milliseconds of that time) are timers:
    a pop past its own gets a null value although its queue stays quiet;
    without, only a later row of the queue answers it.  ``moved`` gives what a
    BLMOVE appends to its destination.
    """
    kept = "values array<struct<value:string,score:double>>, waiting array<struct<client:bigint,deadline:bigint,seq:bigint,side:string>>"
    side = F.coalesce("side", F.lit("left")) if "side" in stream.columns else F.lit("left")
    score = F.col("score").cast("double") if "score" in stream.columns else F.lit(None).cast("double")
    rows = stream.withColumn("side", side).withColumn("score", score).withColumn("scored", F.col("score").isNotNull())
    if "ts" in stream.columns:
        return rows.withWatermark("ts", delay).groupBy("queue").applyInPandasWithState(match_pops_by_time, POPS, kept, "append", GroupStateTimeout.EventTimeTimeout)
    return rows.groupBy("queue").applyInPandasWithState(match_pops, POPS, kept, "append", GroupStateTimeout.NoTimeout)


def moved(served: DataFrame, moves: DataFrame) -> DataFrame:
    """BLMOVE, BRPOPLPUSH: the records that append served values; ``moves``: ``seq, db, destination, into`` (left, right)."""
    both = served.filter("value IS NOT NULL").join(moves, "seq")
    verb = F.when(F.col("into") == "left", "LPUSH").otherwise("RPUSH")
    return both.select(F.col("seq").alias("offset"), "db", verb.alias("verb"), F.array(F.col("destination").cast("binary"), F.col("value").cast("binary")).alias("args"))


def run_to_table(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run a stream over what is there and return its result, written as Parquet into ``out``.

    Rows never pass the driver.  Appended rows go through the file sink, whose
    log tells finished files from those of a lost attempt.  In complete mode
    each micro-batch writes a folder of its own, in whole, and the last counts.
    """
    spark = df.sparkSession
    out = out or f"{shared_folder(spark)}/keyloom/{name}-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{out}-checkpoint")
    last: list[str] = []
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:

        def batch(rows: DataFrame, epoch: int) -> None:
            at = f"{out}/{epoch}"
            rows.write.mode("overwrite").parquet(at)
            last[:] = [at]

        query = writer.foreachBatch(batch).start()
    query.awaitTermination()
    if mode != "append" and not last:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(out if mode == "append" else last[0])


def expire_key(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One key's expiry: the last instant set counts; 0 persists; a timer deletes."""
    if state.hasTimedOut:
        (at,) = state.get
        state.remove()
        yield pd.DataFrame({"key": [key[0]], "expired_at_ms": [at]})
        return
    rows = pd.concat(list(batches)).sort_values("ts")
    at = int(rows["expire_at_ms"].iloc[-1])
    if at:
        state.update((at,))
        state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()


def expiry_timers(stream: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Active expiry over ``key, ts, expire_at_ms``: a row a key once event time passes its expiry."""
    timed = stream.withWatermark("ts", delay)
    return timed.groupBy("key").applyInPandasWithState(expire_key, "key string, expired_at_ms bigint", "at bigint", "append", GroupStateTimeout.EventTimeTimeout)
