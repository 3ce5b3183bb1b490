"""The library works without the training-data subpackage and the pipeline."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys


def test_entry_imports_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__", ".pytest_cache", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'states_asof' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-800:]


def test_nothing_else_imports_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(f"{root}/chronofold"):
        if "llm" not in folder.split(os.sep):
            assert not any("chronofold.llm" in open(f"{folder}/{n}").read() for n in names if n.endswith(".py"))
