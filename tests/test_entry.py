"""The driver's contract, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

HERE = Path(__file__).resolve().parent.parent


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and {r["same"] for r in out.collect()} == {True}


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_other_queries_work_without_the_subpackage(tmp_path):
    shutil.copytree(HERE / "maskwerk", tmp_path / "maskwerk", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(HERE / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"})
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_subpackage():
    for p in (HERE / "maskwerk").rglob("*.py"):
        if "llm" not in p.relative_to(HERE).parts:
            assert "maskwerk.llm" not in p.read_text(), p
