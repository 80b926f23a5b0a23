"""The entry point works without the training-data operators, and names every query's SQL."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_entry_imports_without_the_training_data_operators(tmp_path, also):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *also))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 40 and set(s) <= set(q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PATH": "/usr/bin:/bin"}, check=True)
