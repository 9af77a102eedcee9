"""Queries over whole tables: nothing is left out by an id or a value."""

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")


def against_sql(spark, name, sf=SF):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as e

    db = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    got = e.queries()[name](spark, sf)
    cols = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(cols)} FROM ({e.oracle_sql()[name]})").fetchall()
    rows = [tuple(r[c] for c in cols) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    return rows, db


@pytest.mark.parametrize("name", ["zmscore", "zrank_of"])
def test_every_customer_is_asked_for(spark, name):
    rows, db = against_sql(spark, name)
    assert len(rows) == db.execute("SELECT count(*) FROM customer").fetchone()[0] > 100


def test_every_member_of_a_set(spark):
    rows, db = against_sql(spark, "smembers")
    listed = sorted(int(x) for _, members in rows for x in members.split(","))
    assert listed == [x for (x,) in db.execute("SELECT o_orderkey FROM orders ORDER BY 1").fetchall()]
