"""Operators over whole tables against brute force on small, skewed fixtures."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import decontamination, exact_dedup, fingerprint, sharding, shared, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, salt int"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def corpus(seed=3, n=150):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["The", "ÄÖ", "x,"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(5, 60))) for _ in range(25)]
    rows = []
    for i in range(n):
        t = base[0] if i % 3 == 0 else r.choice(base)  # one text holds a third of the rows
        if r.random() < 0.3:
            t = t.swapcase() if r.random() < 0.3 else t + " " + r.choice(words)
        rows.append(t)
    return rows + [None, "", " ", "one", "two words", "a" * 20000, "a" * 20000]


def docs(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1) for i, t in zip(ids, texts)], DOCS)


def odd_ids(n):
    """Ids with a null and a repeated one."""
    ids = list(range(1000, 1000 + n))
    ids[4], ids[7], ids[8] = None, ids[6], ids[6]
    return ids


def test_exact_dedup(spark):
    texts = corpus()
    ids = odd_ids(len(texts))
    texts[8] = texts[6]  # a repeated row
    groups = defaultdict(list)
    for i, t in zip(ids, texts):
        groups[lower(t)].append(i)
    out = exact_dedup.exact_groups(docs(spark, texts, ids)).collect()
    want = sorted((str(i), max((x for x in groups[lower(t)] if x is not None), default=None), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in zip(ids, texts))
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    assert sum(r.kept for r in out) == len(groups)
    kept = exact_dedup.drop_exact_copies(docs(spark, texts, ids))
    assert kept.columns == docs(spark, []).columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


def test_exact_dedup_is_native(spark):
    plan = exact_dedup.content_runs(docs(spark, ["a"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow(?!WithSchema)", plan.split("== Physical Plan ==")[1])
    assert plan.split("== Physical Plan ==")[1].count("rangepartitioning") == 1 and "hashpartitioning" not in plan


@pytest.mark.parametrize("size", [10, 4])
def test_decontamination(spark, size):
    r = random.Random(9)
    texts = corpus()
    items = [" ".join((texts[k] or "").split()[:14]) for k in (0, 1, 2)] + ["one", "Two  WORDS", "", None, "w1 w2 w3", "nowhere to be found at all in any of the texts", texts[0] + "!"]
    texts += [items[0] + " " + items[0] + " " + items[1], "pre " + " ".join(["one"] * 30)]
    ids = odd_ids(len(texts))
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: word.findall(lower(t))
    wins = [(k, w[i : i + size]) for k, t in enumerate(items) for w in [split(t)] if w for i in range(max(1, len(w) - size + 1))]
    want = []
    for i, t in zip(ids, texts):
        w, hit, found = split(t), set(), set()
        for k, x in wins:
            for at in range(len(w) - len(x) + 1):
                if w[at : at + len(x)] == x:
                    hit.update(range(at, at + len(x)))
                    found.add(str(k))
        want.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    table = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    d = docs(spark, texts, ids)
    out = decontamination.decontaminate(d, table, size).collect()
    assert sorted((str(x.doc_id), x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in out) == sorted(want)
    if size == 10:
        kept = decontamination.drop_contaminated(d, table)
        assert kept.columns == d.columns and kept.count() == sum(not x[-1] for x in want)
    empty = decontamination.decontaminate(d, table.limit(0), size)
    assert empty.filter("contaminated").count() == 0 and empty.count() == len(texts)
    assert decontamination.decontaminate(d.limit(0), table, size).count() == 0
    assert r


def slow_fingerprint(t):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprints():
    for t in corpus() + ["A b\tc\x0bd", "é x y z"]:
        assert fingerprint.fingerprint(t) == slow_fingerprint(t)


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        up[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_links_are_complete(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1, 1 << 63, 0x5555555555555555]
    fps = list({f ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for f in base for _ in range(12)} | set(base))
    want = {tuple(sorted((fingerprint.signed(a), fingerprint.signed(b)))) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= 3}
    df = spark.createDataFrame([(fingerprint.signed(f),) for f in fps], "fp bigint")
    assert {(x.u, x.v) for x in simhash.links(df).collect()} == want and len(want) > 100


def test_components(spark):
    r = random.Random(6)
    pairs = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 300 + i) for i in range(30)]
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    got = {x.node: x.root for x in shared.components(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    find = roots(nodes, [p for p in pairs if p[0] != p[1]])
    least = {}
    for n in nodes:
        least[find[n]] = min(n, least.get(find[n], n))
    assert got == {n: least[find[n]] for n in nodes}


def test_near_duplicates(spark):
    r = random.Random(8)
    long = " ".join(f"t{r.randint(0, 500)}" for _ in range(400))
    texts = corpus(n=90) + [long] + [long + f" e{k}" for k in range(6)] + [long.upper(), "  "]
    ids = odd_ids(len(texts))
    fps = [slow_fingerprint(t) for t in texts]
    nodes = set(fps)
    find = roots(nodes, [(a, b) for a in nodes for b in nodes if (a ^ b).bit_count() <= 3])
    least = {}
    for i, f in zip(ids, fps):
        if i is not None:
            least[find[f]] = min(i, least.get(find[f], i))
    want = sorted((str(i), f"{f:016x}", least.get(find[f])) for i, f in zip(ids, fps))
    d = docs(spark, texts, ids)
    assert sorted((str(x.doc_id), x.fingerprint, x.component_id) for x in simhash.near_duplicates(d).collect()) == want
    kept = simhash.keep_one_of_each(d)
    assert kept.columns == d.columns and kept.count() == len(set(find.values()))
    assert simhash.near_duplicates(d.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [0, 200])
def test_sharding(spark, hot):
    texts = [f"text {i} " * (i % 17) for i in range(300)] + ["hot text of many rows"] * hot + [None, None, "", "x" * 50_000]
    ids = odd_ids(len(texts))
    out = sharding.shard(docs(spark, texts, ids), 8).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((str(x.doc_id), x.size, x.text_crc32) for x in out) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in zip(ids, texts))
    total, largest = sum(map(size, texts)), max(map(size, texts))
    slots, sums = defaultdict(list), defaultdict(int)
    for x in out:
        slots[x.shard].append(x.slot)
        sums[x.shard] += x.size
    for s, found in slots.items():
        assert sorted(found) == list(range(len(found))) and 0 <= s < 8
        assert abs(sums[s] - total / 8) <= largest + total / 8 * 0.01
    assert {(x.law, x.grown_shard) for x in out} == {("bytes", None)}
    assert sharding.shard(docs(spark, []), 8).count() == 0


def test_attach_keeps_hot_keys(spark):
    rows = spark.range(1000).select((F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    out = shared.attach(rows, groups, "k", "n", 1000)
    assert out.count() == 1000 and out.filter("least is null").count() == 0 and out.filter("k = 0").agg(F.max("least")).first()[0] == 0


@pytest.mark.parametrize("few", [0, 5])
def test_decontamination_without_broadcasts(spark, few):
    """Benchmark tables of more rows than may be broadcast give the same rows."""
    texts = corpus()
    items = [" ".join((texts[k] or "").split()[:14]) for k in (0, 1, 2)] + ["one", "Two  WORDS", "", None, "w1 w2 w3", texts[0] + "!"]
    table = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    d = docs(spark, texts, odd_ids(len(texts)))
    rows = lambda n: sorted(map(str, decontamination.decontaminate(d, table, few=n).collect()))
    assert rows(few) == rows(decontamination.BROADCAST_ROWS)


def test_drop_contaminated_keeps_clashing_columns(spark):
    d = docs(spark, corpus(n=30)).withColumns({c: F.lit(c) for c in ("_key", "bad", "hash", "w", "window")})
    table = spark.createDataFrame([(1, corpus()[0])], "item_id bigint, text string")
    kept = decontamination.drop_contaminated(d, table)
    assert kept.columns == d.columns and 0 < kept.count() < d.count()
    assert kept.select("_key", "bad", "hash", "w", "window").distinct().collect() == [("_key", "bad", "hash", "w", "window")]


def test_exact_groups_come_from_neighbours(spark):
    """A text in a third of the rows spreads over ranges, texts of one head are told apart, and no worker is Python's."""
    head = "the same first characters of many texts, more than are looked at by the ranges "
    texts = ["HOT text"] * 200 + [head + str(k % 40) for k in range(200)] + [f"{k} own" for k in range(200)] + [None, ""]
    d = docs(spark, texts)
    runs = exact_dedup.content_runs(d).select("heavy", "salt", "norm", "opens").collect()
    assert len({r.salt for r in runs if r.norm == "hot text"}) > 20 and not any(r.salt for r in runs if not r.heavy)
    out = {r.doc_id: r for r in exact_dedup.exact_groups(d).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[lower(t)].append(i)
    for i, t in enumerate(texts):
        mine = groups[lower(t)]
        assert (out[i].keep_id, out[i].group_size, out[i].kept) == (max(mine), len(mine), i == max(mine))
    plan = exact_dedup.exact_groups(d)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


def test_drop_exact_copies_keeps_clashing_columns(spark):
    names = ("_sha", "row", "norm", "head", "heavy", "opens", "run", "keep_id", "hash", "dot.ted")
    d = docs(spark, corpus(n=40)).withColumns({c: F.lit(c) for c in names})
    kept = exact_dedup.drop_exact_copies(d)
    assert kept.columns == d.columns and kept.count() == len({lower(t) for t in corpus(n=40)})
    assert kept.select(*[f"`{c}`" for c in names]).distinct().collect() == [names]


def test_keep_one_of_each_keeps_clashing_columns(spark):
    names = ("_th", "th", "text_hash", "kept_id", "kept_hash", "root", "fp")
    d = docs(spark, corpus(n=30)).withColumns({c: F.lit(c) for c in names})
    kept = simhash.keep_one_of_each(d)
    assert kept.columns == d.columns and 0 < kept.count() < d.count()
    assert kept.select(*names).distinct().collect() == [names]


def test_sharded_files_keep_clashing_columns(spark, tmp_path):
    d = docs(spark, corpus(n=30)).withColumns({c: F.lit(c) for c in ("h", "g", "shard", "row")})
    sharding.write_sharded(d, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*d.columns, "shard_"} and back.count() == d.count()
    assert back.select("h", "g", "shard", "row").distinct().collect() == [("h", "g", "shard", "row")]
