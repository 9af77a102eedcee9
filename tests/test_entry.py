"""The driver's contract, and that the core stands without the training-data subpackage."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def test_queries_and_oracles():
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(e.oracle_sql()) <= names and len(names) > 90


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")
def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["key", "member", "score", "idx"] and 0 < out.count() <= 15


def test_core_does_not_import_the_subpackage():
    for path in (ROOT / "keyloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", path.read_text(), re.M), path


def test_entry_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "keyloom", tmp_path / "keyloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n.startswith('op1') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data here")
@pytest.mark.parametrize("name", ["zrevrange_topk", "zunion_weighted", "sinter", "lrem", "hincrby", "expire_gt", "evict_lru", "keys_glob"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from keyloom import catalog

    db = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(cols)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_plans(spark):
    """Ranges reach the scan, top-k keeps few rows a key before the shuffle, and nothing runs in Python."""
    if not Path(SF).exists():
        pytest.skip("no test data here")
    from keyloom import catalog

    def plan(name):
        return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()

    assert "WindowGroupLimit" in plan("zrevrange_topk") and "WindowGroupLimit" in plan("zpopmin")
    assert re.search(r"PushedFilters: \[[^]]*(Greater|Less)Than", plan("zrangebyscore_limit"))
    for name in ("zrevrange_topk", "zunion_weighted", "sinter", "hincrby", "lrem", "ttl", "incr_running", "keys_glob"):
        assert "Python" not in plan(name) and "Arrow" not in plan(name)
