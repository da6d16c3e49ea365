"""The entry point with and without the text part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), *sorted(e.queries()))"


@pytest.mark.parametrize("gone", [["estilens/llm", "tests/llm"], ["estilens/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_text_part(tmp_path, gone):
    """A copy that never had the folders lists the review queries, each with its SQL."""
    root = tmp_path / "copy"
    left_out = {os.path.join(ROOT, g) for g in gone} | {os.path.join(ROOT, ".git")}
    shutil.copytree(ROOT, root, ignore=lambda at, names: [n for n in names if os.path.join(at, n) in left_out or n == "__pycache__"])
    out = subprocess.run([sys.executable, "-c", LIST], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, oracles, *names = out.stdout.split()
    assert n == oracles and not [x for x in names if x.startswith("op") and x[2].isdigit() or x == "pipeline"]
