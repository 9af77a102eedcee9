"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 32 segments of two bits are mapped to their bit counts.  The
Manhattan distance of two such vectors is at most the Hamming distance of the
fingerprints.  Of two vectors within distance 3, one half of 16 counts is
within 1, so a grid join finds every pair: a fingerprint lies in the cell of
each half, and looks into that cell and those one step up (the other of the
pair looks the other way).  The bound is then applied to the whole vector and
the Hamming distance verified.  Equal fingerprints are joined beforehand, so
copies never form pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .fingerprint import fingerprint, signed
from .shared import attach, components, unused, written

DISTANCE = 3
_PAIRS = 0x5555555555555555


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, th, fp`` of each row: text hash, and the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [signed(fingerprint(x.as_py(), width)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(fps, pa.int64())], ["doc_id", "th", "fp"])

    return docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(run, "doc_id long, th long, fp long")


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``u, v``: every pair of the distinct ``fp`` that differ in 1 to ``distance`` (at most 3) bits."""
    if distance > 3:
        raise ValueError("the grid finds pairs within distance 3")
    # Two-bit fields of the segments' bit counts.
    counts = distinct.select("fp", F.expr(f"((fp ^ shiftrightunsigned(fp, 1)) & {_PAIRS}) | shiftleft(fp & shiftrightunsigned(fp, 1) & {_PAIRS}, 1)").alias("c"))
    halves = counts.select("fp", "c", F.explode(F.expr("array(struct(0 as half, c & 4294967295 as code), struct(1 as half, shiftrightunsigned(c, 32) as code))")).alias("x"))
    cells = halves.select("fp", "c", "x.half", "x.code")
    # A step up: one count 0 or 1 grows by one.
    up = "filter(transform(sequence(0, 30, 2), s -> IF((shiftrightunsigned(code, s) & 3L) < 2, code + shiftleft(1L, s), NULL)), y -> y IS NOT NULL)"
    looks = cells.select("fp", "c", "half", F.explode(F.expr(f"concat(array(code), {up})")).alias("code"))
    a, b = looks.alias("a"), cells.alias("b")
    # Manhattan distance of two-bit counts 0..2: sum of |x - y| over fields, by the bits of x ^ y.
    far = "bit_count((a.c ^ b.c) & 6148914691236517205L) + 2 * bit_count((a.c ^ b.c) & shiftleft(6148914691236517205L, 1) & ~shiftleft((a.c ^ b.c) & 6148914691236517205L, 1))"
    met = a.join(b, (F.col("a.half") == F.col("b.half")) & (F.col("a.code") == F.col("b.code")) & F.expr(f"a.fp <> b.fp AND {far} <= {distance} AND bit_count(a.fp ^ b.fp) <= {distance}"))
    return met.select(F.least("a.fp", "b.fp").alias("u"), F.greatest("a.fp", "b.fp").alias("v")).distinct()


def classes(docs: DataFrame, width: int = 3, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, th, fp, root, component_id`` of each row; ``root`` is the component's smallest fingerprint."""
    rows = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    groups = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "fingerprint-groups")
    total = groups.agg(F.sum("copies")).first()[0] or 0
    members = components(links(groups.select("fp"), distance))
    named = groups.join(members.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = written(named.join(ids, "root").select("fp", "copies", "root", "component_id"), "fingerprint-classes")
    return attach(rows, found, "fp", "copies", total)


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``, one row per row of ``docs``.

    ``component_id``: the smallest id that links reach, the row's own included.
    Null, empty and word-free texts have fingerprint zero and link like any
    other.  Null ids are no component's name unless all its ids are null.  Rows
    that repeat are rows of one component; an empty table gives no rows;
    further columns are not read.
    """
    out = classes(docs, width, distance, id_col, text_col)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate component, the one with the smallest id, with all columns."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("x")
    id_name, hash_name, mine = (unused(docs, c) for c in ("kept_id", "kept_hash", "text_hash"))
    kept = classes(docs).groupBy("root").agg(first).select(F.col("x.doc_id").alias(id_name), F.col("x.th").alias(hash_name))
    rows = docs.withColumn(mine, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(id_name)) & (F.col(mine) == F.col(hash_name))
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", mine]).drop(mine)
