"""The driver's contract, with and without the corpus operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).resolve().parent


def test_contract(spark, data):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert all(isinstance(s, str) for s in sql.values())
    assert entry.entry(spark).count() == 1


def test_entry_works_without_the_corpus_operators(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("corpus_pipeline.py", "plumbline", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "plumbline").mkdir()
    for p in (ROOT / "plumbline").iterdir():
        if p.name != "llm":
            (tmp_path / "plumbline" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'choice_decide' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True, timeout=60)


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "plumbline").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
