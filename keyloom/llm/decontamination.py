"""Benchmark decontamination by a prefix-filtered set join, DataFrame operations only.

An item's windows are its runs of ``size`` words.  A window occurs in a
document only if each of its three-word shingles does, so one shingle, the
window's rarest over all documents, is a necessary prefix.  Document shingles
are joined with these prefixes alone; the position of the shingle in the
window gives where the window must start and end (positional and length
bounds), and the words there are compared exactly.  Texts are split twice:
once to count shingles, once to match, which also counts their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import normal_text, unused, written

#: What separates words; the split leaves an empty string only before the first or after the last.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 10
SHINGLE = 3
#: Benchmark tables up to so many rows (some 100 bytes each) are broadcast; larger ones are joined by a salted shuffle.
BROADCAST_ROWS = 200_000
SALTS = 16


def words(text: Column) -> Column:
    return F.array_remove(F.split(normal_text(text), BETWEEN), "")


def _shingle(array: str, at: str, width: int) -> str:
    """SQL of the hash of ``width`` words from a place (from 0)."""
    return f"xxhash64({width}, " + ", ".join(f"{array}[{at} + {k}]" for k in range(width)) + ")"


def windows(items: DataFrame, size: int = SIZE, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: ``window`` (words), ``n`` (their number), ``item_id``."""
    w = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).filter("size(w) > 0")
    at = w.select("item_id", "w", F.explode(F.expr(f"sequence(0, greatest(size(w) - {size}, 0))")).alias("at"))
    return at.select("item_id", F.expr(f"slice(w, at + 1, {size})").alias("window")).distinct().withColumn("n", F.size("window"))


def _few(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows, counted."""
    return df.limit(rows + 1).count() <= rows


def _meet(rows: DataFrame, table: DataFrame, on: str, salt: Column, few: int) -> DataFrame:
    """Join with a table of the benchmark: broadcast if it is small, else shuffled with the hot keys of ``rows`` salted."""
    if _few(table, few):
        return rows.join(F.broadcast(table), on)
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(copies, [on, "_salt"]).drop("_salt")


def _places(docs: DataFrame, width: int, first: int) -> DataFrame:
    """One row a place: ``key, w, pos, h``.  ``first`` is 0, or -1 for a row without a hash at each document's head.

    An outer explode: Spark would push an inner one's emptiness test below and split every text twice.
    """
    at = f"IF(size(w) >= {width} OR {first} < 0, sequence({first}, greatest(size(w) - {width}, {first})), NULL)"
    places = docs.select("key", "w", F.explode_outer(F.expr(at)).alias("pos")).filter("pos IS NOT NULL")
    return places.withColumn("h", F.expr(f"IF(pos >= 0 AND pos + {width} <= size(w), {_shingle('w', 'pos', width)}, NULL)"))


def prefixes(docs: DataFrame, wins: DataFrame, width: int, few: int = BROADCAST_ROWS) -> DataFrame:
    """``window, n, h, at``: each window's rarest shingle over all documents, and its place in the window."""
    parts = wins.select("window", "n", F.explode(F.expr(f"sequence(0, n - {width})")).alias("at"))
    parts = parts.withColumn("h", F.expr(_shingle("window", "at", width)))
    known, seen = parts.select("h").distinct(), _places(docs, width, 0).select("h")
    if _few(known, few):
        counts = seen.join(F.broadcast(known), "h").groupBy("h").agg(F.count("*").alias("df"))
    else:  # counted before the join, so that no frequent shingle meets in one task
        counts = seen.groupBy("h").agg(F.count("*").alias("df")).join(known, "h")
    ranked = parts.join(counts, "h", "left").groupBy("window", "n")
    ranked = ranked.agg(F.min_by(F.struct("h", "at"), F.struct(F.coalesce("df", F.lit(0)), "h", "at")).alias("p"))
    return written(ranked.select("window", "n", "p.h", "p.at"), "window-prefixes")


def occurrences(docs: DataFrame, wins: DataFrame, width: int, few: int = BROADCAST_ROWS) -> DataFrame:
    """``key, n_words, start, n, window``: every place where a window of at least ``width`` words occurs.

    One more row of each document, with a null ``start``, has its number of
    words; it is null in the others.  ``docs``: ``key, w``; ``wins``: ``window, n``.
    """
    table = prefixes(docs, wins, width, few)
    fits = "start >= 0 AND start + n <= size(w) AND slice(w, start + 1, n) = window"
    out = ("key", "n_words", "start", "n", "window")
    if _few(table, few):
        met = _places(docs, width, -1).join(F.broadcast(table), "h", "left").withColumn("start", F.col("pos") - F.col("at"))
        met = met.filter(f"pos < 0 OR ({fits})")
        return met.withColumn("n_words", F.expr("IF(pos < 0, size(w), NULL)")).select(*out)
    # A benchmark beyond broadcasting: places go without their words, which are fetched for the documents that matched.
    places = _places(docs, width, 0).select("key", "pos", "h")
    met = _meet(places, table, "h", F.xxhash64("key", "pos"), few).withColumn("start", F.col("pos") - F.col("at")).filter("start >= 0")
    met = met.groupBy("key").agg(F.collect_set(F.struct("start", "n", "window")).alias("met")).withColumnRenamed("key", "met_key")
    # The words are a lambda's variable, so that a text is split once.
    both = docs.join(met, F.col("key").eqNullSafe(F.col("met_key")), "left")
    found = F.expr("transform(array(w), w -> struct(size(w) AS n_words, filter(met, x -> x.start + x.n <= size(w) AND slice(w, x.start + 1, x.n) = x.window) AS hits))[0]")
    both = both.select("key", found.alias("f"))
    mark = F.expr("array(struct(f.n_words AS n_words, cast(null AS int) AS start, cast(null AS int) AS n, cast(null AS array<string>) AS window))")
    hits = F.expr("transform(coalesce(f.hits, array()), x -> struct(cast(null AS int) AS n_words, x.start AS start, x.n AS n, x.window AS window))")
    return both.select("key", F.explode(F.concat(mark, hits)).alias("x")).select("key", "x.*").select(*out)


def decontaminate(docs: DataFrame, items: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False, few: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of each row.

    A window is ``size`` consecutive words of an item; an item of fewer words,
    but not none, is one window.  A document word inside any occurrence of a
    window is hit.  Null has no words.  Rows that repeat id and text each get
    the same result; a null id is a value like others; null item ids are left
    out of the list.  Empty tables give no rows, or no hits.  Benchmark tables
    of up to ``few`` rows are broadcast.
    """
    rows = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash")).alias("key"), words(F.col(text_col)).alias("w"))
    wins = windows(items, size)
    distinct = wins.select("window", "n").distinct()
    found = occurrences(rows, distinct.filter(f"n >= {SHINGLE}"), SHINGLE, few)
    if not wins.filter(f"n < {SHINGLE}").isEmpty():
        short = occurrences(rows, distinct.filter(f"n < {SHINGLE}"), 1, few)
        found = found.unionByName(short.filter("start IS NOT NULL"))
    # Used three times below; it holds the hits and one narrow row a document.
    found = written(found, "window-hits")
    hits = found.filter("start IS NOT NULL")
    # Hit words: the union of the intervals, a document at a time (bounded by its own length).
    spans = hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop")))).alias("spans"))
    covered = F.expr(
        "aggregate(spans, named_struct('stop', 0, 'hit', 0L), (a, x) -> named_struct("
        "'stop', greatest(a.stop, x.stop), 'hit', a.hit + greatest(0, x.stop - greatest(a.stop, x.start))), a -> a.hit)"
    )
    spans = spans.select("key", covered.alias("n_hit"))
    met = hits.select("key", "window").distinct()
    pairs = _meet(met, wins.select("window", "item_id"), "window", F.xxhash64("key"), few).select("key", "item_id").distinct()
    lists = pairs.groupBy("key").agg(F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("ids"))
    of = spans.join(lists, "key", "left").withColumnRenamed("key", "hit_key")
    out = found.filter("n_words IS NOT NULL").join(of, F.col("key").eqNullSafe(F.col("hit_key")), "left")
    return out.select(
        *(["key"] if keyed else []),
        F.col("key.id").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns, whatever their names."""
    mine, bad = unused(docs, "key"), unused(docs, "bad")
    found = decontaminate(docs, items, keyed=True).filter("contaminated").select(F.col("key").alias(bad)).distinct()
    rows = docs.withColumn(mine, F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")))
    return rows.join(found, F.col(mine).eqNullSafe(F.col(bad)), "left_anti").drop(mine)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, len(w[i:i+9]) AS n, array_to_string(w[i:i+9], ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
place AS (SELECT d.doc_id, i AS p0, sizes.n, array_to_string(w[i:i+sizes.n-1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - sizes.n + 2)) AS t(i)),
occ AS (SELECT place.doc_id, place.p0, place.n, win.item_id FROM place JOIN win ON place.n = win.n AND place.s = win.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(p0, p0 + n)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
