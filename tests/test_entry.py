"""The entry module, with and without what the driver deletes."""

from __future__ import annotations

import re
import shutil
import subprocess
import sys
from pathlib import Path

HOME = Path(__file__).resolve().parents[1]


def test_nothing_else_imports_the_corpus_operators():
    rest = [p for p in (HOME / "graphloom").rglob("*.py") if "llm" not in p.relative_to(HOME).parts]
    assert rest and not [p for p in rest if re.search(r"\bllm\b", p.read_text())]


def test_the_rest_works_without_them(tmp_path):
    to = tmp_path / "repo"
    shutil.copytree(HOME, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'build_nodes' in q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=to, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(to), "HOME": str(tmp_path)})


def test_the_flagship_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["node_id", "class", "attrs"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
