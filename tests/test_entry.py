"""The entry point without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
LISTED = "import __spark_entry__ as e; print(sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


def copied(to):
    skip = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse", "metastore_db")
    shutil.copytree(REPO, to, ignore=skip)
    return to


def names(folder, code=LISTED):
    run = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return eval(run.stdout)


@pytest.mark.parametrize("pipeline", [True, False])
def test_rest_stands_without_the_subpackage(tmp_path, pipeline):
    left = copied(tmp_path / "repo")
    for folder in ("skuloom/llm", "tests/llm"):
        shutil.rmtree(left / folder, ignore_errors=True)
    if not pipeline:
        (left / "corpus_pipeline.py").unlink(missing_ok=True)
    found = names(left)
    assert "average_rmse" in found and not [n for n in found if n.startswith("op") and n[2].isdigit()] and "pipeline" not in found


def test_rest_stands_without_a_library(tmp_path):
    left = copied(tmp_path / "repo")
    found = names(left, "import sys; sys.modules['zstandard'] = None\n" + LISTED)
    assert "average_rmse" in found and not [n for n in found if n.startswith("op") and n[2].isdigit()]
