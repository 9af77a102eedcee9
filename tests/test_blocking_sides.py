"""Blocking pops from either end of a list."""

from keyloom.streaming import jobs

DDL = "queue string, seq bigint, at_ms bigint, kind string, client bigint, value string, deadline_ms bigint, side string"


def test_brpop_takes_the_tail(spark, tmp_path):
    src = str(tmp_path / "q")
    data = [("q", k, 0, "push", None, v, 0, None) for k, v in enumerate("abc")] + [("q", 4, 0, "pop", 7, None, 0, "right"), ("q", 5, 0, "pop", 8, None, 0, "left"), ("q", 6, 0, "pop", 9, None, 0, None)]
    spark.createDataFrame(data, DDL).coalesce(1).write.parquet(src)
    out = jobs.run_to_table(jobs.blocking_pops(jobs.tail(spark, src, DDL)), "sides", "append")
    assert sorted((r.client, r.value) for r in out.collect()) == [(7, "c"), (8, "a"), (9, "b")]
