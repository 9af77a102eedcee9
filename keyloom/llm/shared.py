"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.shared import shared_folder, written

__all__ = ["attach", "components", "normal_text", "shared_folder", "unused", "written"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A group that holds at least one in so many of all rows is heavy.  There are
#: at most so many heavy groups, whatever the input: a proven broadcast bound.
HEAVY_PARTS = 512


def normal_text(text: Column) -> Column:
    """Null as empty, and A-Z (nothing else) in lower case."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left-join ``groups`` (one row a key, ``size`` rows each) to ``rows``.

    Keys with at least ``total / HEAVY_PARTS`` rows are at most ``HEAVY_PARTS``
    many and are broadcast, so no task meets a hot key; the rest, whose keys
    are all light, meet in a shuffled join.
    """
    least = max(1, -(-total // HEAVY_PARTS))
    heavy = groups.filter(F.col(size) >= least).withColumn("_heavy", F.lit(True))
    light = groups.filter(F.col(size) < least)
    first = rows.join(F.broadcast(heavy), key, "left")
    hot = first.filter(F.col("_heavy").isNotNull()).drop("_heavy")
    cold = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, "left")
    return hot.select(*cold.columns).unionByName(cold)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(u, v)``: rows ``(node, root)``.

    ``root`` is the smallest node of the component.  Alternates large-star and
    small-star steps until the edge set is a forest of stars; every step is a
    pre-aggregated minimum and a join, and its result is a written table.
    """
    pairs = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pairs = written(pairs.distinct(), name)
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = written(low.select("u", F.col("m").alias("v")).unionByName(small).filter("u <> v").distinct(), name)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
