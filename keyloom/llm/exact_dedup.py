"""Exact deduplication by content sort, with DataFrame operations only.

Normalised texts are range-partitioned by sampled splitters on their first
characters and sorted within their ranges (Spark's external sort), so that
equals stand next to each other; each row is compared with its neighbour in
full, and a run of equals is a group.  First characters that many rows share
are salted with the row's id, so one text that a third of all rows share still
spreads over many ranges; the runs of such ranges, one row each, are merged by
a second content sort that compares their texts in full again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import HEAVY_PARTS, attach, normal_text, written

SALTS = 64
#: Characters of a text that ranges are cut by.
HEAD = 64


def _neighbours(ranged: DataFrame, by: tuple[str, ...], norm: str, first: Column) -> DataFrame:
    """Add ``opens`` (differs from the row before it) and ``run`` (number in its range key) to range-partitioned rows."""
    # The window's keys are the range keys: no further exchange, one external sort.
    near = Window.partitionBy(*by).orderBy(norm, first.desc_nulls_last())
    out = ranged.withColumn("opens", F.coalesce(F.lag(norm).over(near) != F.col(norm), F.lit(True)))
    return out.withColumn("run", F.sum(F.col("opens").cast("long")).over(near.rowsBetween(Window.unboundedPreceding, 0)))


def _heavy_heads(rows: DataFrame) -> DataFrame:
    """First characters of at least one in ``HEAVY_PARTS`` of all rows: that many at most, a proven broadcast bound."""
    least = max(2, -(-rows.count() // HEAVY_PARTS))
    counts = rows.groupBy("head").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return written(counts.select("head", F.lit(True).alias("heavy")), "content-heads")


def content_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs`` after the content sort: ``doc_id, row, norm, head, heavy, salt, opens, run``.

    ``row`` has all columns of ``docs``; a run starts where ``opens``, with the
    largest id, and is numbered within ``head, salt``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # The head alone is normalised before the exchange: sampling splitters reads no whole text.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), normal_text(F.substring(text, 1, HEAD)).alias("head"))
    heavy = _heavy_heads(rows.select("head"))
    rows = rows.join(F.broadcast(heavy), "head", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    rows = rows.withColumn("salt", F.when(F.col("heavy"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")).otherwise(0))
    ranged = rows.repartitionByRange("head", "salt").withColumn("norm", normal_text(F.col("row")[text_col]))
    return _neighbours(ranged, ("head", "salt"), "norm", F.col("doc_id"))


def _merged(runs: DataFrame) -> DataFrame:
    """Runs of salted heads, ``head, norm, keep_id, ...``, after a second content sort; a hot text has one row a salt."""
    ranged = runs.withColumn("hash", F.xxhash64("norm")).repartitionByRange("head", "hash")
    return _neighbours(ranged, ("head", "hash"), "norm", F.col("keep_id"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z only; null counts as
    empty.  Of a group the row with the largest id stays; a null id is smaller
    than any.  Rows that repeat both id and text: one of them is kept.  An
    empty table gives no rows; further columns are not read.
    """
    rows = content_runs(docs.select(id_col, text_col), id_col, text_col)
    key = F.struct("head", "salt", "run").alias("key")
    rows = rows.select("doc_id", "head", "salt", "run", "heavy", "opens", F.unhex(F.sha2("norm", 256)).alias("digest"), F.when(F.col("heavy") & F.col("opens"), F.col("norm")).alias("norm"))
    one = Window.partitionBy("head", "salt", "run")
    rows = written(rows.withColumn("keep_id", F.max("doc_id").over(one)).withColumn("group_size", F.count("*").over(one)), "content-sort")
    runs = _merged(rows.filter("norm IS NOT NULL").select("head", "salt", F.col("run").alias("part"), "norm", "keep_id", "group_size"))
    one = Window.partitionBy("head", "hash", "run")
    whole = runs.select(F.struct("head", "salt", F.col("part").alias("run")).alias("key"), F.max("keep_id").over(one).alias("keep_id"), F.sum("group_size").over(one).alias("group_size"), F.col("group_size").alias("rows"))
    whole = written(whole, "content-groups")
    out = ["doc_id", "keep_id", "group_size", "opens", "digest"]
    light = rows.filter("NOT heavy").select(*out)
    total = whole.agg(F.sum("rows")).first()[0] or 0
    hot = attach(rows.filter("heavy").select("doc_id", "opens", "digest", key), whole, "key", "rows", total)
    return light.unionByName(hot.select(*out)).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("opens") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names: the first of every run."""
    rows = content_runs(docs).filter("opens")
    rows = written(rows.select("row", "heavy", F.col("doc_id").alias("keep_id"), F.when(F.col("heavy"), F.col("head")).alias("head"), F.when(F.col("heavy"), F.col("norm")).alias("norm")), "content-sort")
    merged = _merged(rows.filter("heavy").drop("heavy")).filter("opens")
    return rows.filter("NOT heavy").select("row.*").unionByName(merged.select("row.*"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
