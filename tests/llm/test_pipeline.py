"""The corpus pipeline against its stages' brute-force meaning, on a small corpus on disk."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(1)
    word = lambda: f"v{r.randint(0, 3000)}"
    texts = [" ".join(word() for _ in range(80)) for _ in range(40)]
    leak = " ".join(word() for _ in range(12))
    texts += [texts[0].upper(), texts[0], "you idiot " + texts[2], texts[3] + " " + leak, None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i == 42)) for i in range(0, 44, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, left = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        left.append({x.doc_id for x in docs.select("doc_id").collect()})
    assert left[0] == set(range(45)) - {42}
    assert left[1] == left[0] - {0, 40}
    assert left[2] <= left[1] and left[2] >= left[1] - {43, 3}
    assert left[3] == left[2] - {43}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {x.doc_id for x in packed.select("doc_id").collect()} == left[3]


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.groupBy("doc_id").agg((F.sum("length") == F.max("doc_tokens")).alias("ok")).filter("not ok").count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontamination", "packing"]
