"""The repository works without its optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LISTED = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q), set(o) - set(q); print(*sorted(q))"


def _copy(to):
    skip = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache")
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, to / name)
    shutil.copytree(ROOT / "paperloom", to / "paperloom", ignore=skip)
    return to


def _names(folder):
    run = subprocess.run([sys.executable, "-c", LISTED], cwd=folder, capture_output=True, text=True, check=False, timeout=120)
    assert run.returncode == 0, run.stderr
    return set(run.stdout.split())


@pytest.mark.parametrize("left", ["nothing", "caches", "no pipeline file"])
def test_queries_without_training_operators(tmp_path, left):
    copy = _copy(tmp_path)
    shutil.rmtree(copy / "paperloom" / "llm", ignore_errors=True)
    if left == "caches":
        (copy / "paperloom" / "llm" / "__pycache__").mkdir(parents=True)
    if left == "no pipeline file":
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    names = _names(copy)
    assert {"table_cells", "segment_blocks"} <= names
    assert not [n for n in names if n.startswith("op") and n[2].isdigit() or n == "pipeline"]


def test_all_queries_with_them():
    if (ROOT / "paperloom" / "llm" / "queries.py").exists():
        assert {"pipeline", "op1_pseudonymise"} <= _names(ROOT)
