"""The library works without the training-data operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

from .conftest import ROOT


def test_without_training_data_operators(tmp_path):
    """With those folders and the pipeline gone, the entry points import and give the other queries."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); assert set(q) >= set(e.oracle_sql())"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, env={"PYTHONPATH": str(copy), "PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    assert done.returncode == 0, done.stderr


def test_other_tests_pass_without_them(tmp_path):
    """Some of the remaining tests, in a copy without those folders."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    picked = "test_entry_points or test_query[scene_summary] or test_fit_and_ratio"
    env = {**os.environ, "PYTHONPATH": str(copy)}
    done = subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "-p", "no:cacheprovider", "tests", "-k", picked], cwd=copy, capture_output=True, text=True, env=env)
    assert done.returncode == 0 and "3 passed" in done.stdout, done.stdout + done.stderr


def test_nothing_imports_them():
    for path in (ROOT / "strataframe").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
