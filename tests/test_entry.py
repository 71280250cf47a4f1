"""The entry point with and without the optional text operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import __spark_entry__ as entry
print(len(entry.queries()), sorted(n for n in entry.queries() if not n.startswith("q")))
assert set(entry.oracle_sql()) <= set(entry.queries())
"""


@pytest.mark.parametrize("gone", [("tablescout/llm",), ("tablescout/llm", "corpus_pipeline.py")])
def test_entry_imports_without_the_text_operators(tmp_path, gone):
    kept = shutil.ignore_patterns(".git", "__pycache__", "tests", "*.json", "*.md")
    without = {os.path.join(ROOT, name) for name in gone}

    def ignored(folder, names):
        return kept(folder, names) | {n for n in names if os.path.join(folder, n) in without}

    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=ignored)
    run = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, capture_output=True, text=True, timeout=120,
                         env=os.environ | {"PYTHONPATH": str(copy)})
    assert run.returncode == 0, run.stderr
    assert run.stdout.strip().endswith("[]")
