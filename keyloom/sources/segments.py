"""The log as numbered segment folders of one Parquet table: append, roll, list and prune."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A segment that has reached so many bytes takes no more records.
MAX_BYTES = 1 << 30


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever store its path names."""
    files, at = _path(spark, path)
    return files.exists(at)


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the segment folders, ascending."""
    files, at = _path(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n.split("=", 1)[1]) for n in names if n.startswith("segment="))


def current(spark: SparkSession, path: str) -> int:
    """The segment that takes new records; 0 for a new log."""
    numbers = _numbers(spark, path)
    return numbers[-1] if numbers else 0


def append(effects: DataFrame, path: str, max_bytes: int = MAX_BYTES) -> int:
    """Append records to the current segment, or to the next if it is full; its number.

    One writer at a time; readers see whole files only.
    """
    spark = effects.sparkSession
    files, _ = _path(spark, path)
    number = current(spark, path)
    at = _path(spark, f"{path}/segment={number}")[1]
    if files.exists(at) and files.getContentSummary(at).getLength() >= max_bytes:
        number += 1
    effects.write.mode("append").parquet(f"{path}/segment={number}")
    return number


def roll(effects: DataFrame, path: str) -> int:
    """Close the current segment: these records begin the next one; its number."""
    spark = effects.sparkSession
    numbers = _numbers(spark, path)
    number = numbers[-1] + 1 if numbers else 0
    effects.write.mode("append").parquet(f"{path}/segment={number}")
    return number


def bounds(spark: SparkSession, path: str) -> DataFrame:
    """``segment, first, last``: the offsets each segment holds, from the files' statistics where they have them."""
    return spark.read.parquet(path).groupBy("segment").agg(F.min("offset").alias("first"), F.max("offset").alias("last"))


def prune(spark: SparkSession, path: str, below: int) -> list[int]:
    """Delete the segments that hold only offsets below one, except the current; their numbers."""
    numbers = _numbers(spark, path)
    if len(numbers) < 2:
        return []
    # One row a segment.
    old = sorted(r["segment"] for r in bounds(spark, path).filter((F.col("last") < below) & (F.col("segment") < numbers[-1])).collect())
    files, _ = _path(spark, path)
    for number in old:
        files.delete(_path(spark, f"{path}/segment={number}")[1], True)
    return old


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    files, at = _path(spark, path)
    files.delete(at, True)
