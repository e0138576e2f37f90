import importlib.util
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_imports_without_the_training_data_modules(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *gone))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q) and 'pipeline' not in q and not [n for n in q if n.startswith('op')]"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_them():
    for path in (ROOT / "redline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "redline.llm" not in path.read_text()


@pytest.mark.skipif(not DATA.exists(), reason="driver tables")
def test_entry_and_a_query_against_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    con = duckdb.connect()
    for name in ("lineitem", "orders", "events", "documents"):
        con.execute(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    for name in ("status_histogram", "task_latest", "line_anchors", "first_table_change"):
        got = entry.queries()[name](spark, str(DATA))
        found = con.execute(entry.oracle_sql()[name])
        order = [d[0] for d in found.description]
        assert sorted(order) == sorted(got.columns)
        assert sorted(map(repr, map(tuple, got.select(*order).collect()))) == sorted(map(repr, found.fetchall()))
    assert importlib.util.find_spec("redline") is not None
