"""The library without the corpus operators, and with corpus operators that can't be imported."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
SAYS = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*sorted(q))"


def names(folder):
    done = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=folder, capture_output=True, text=True, check=True)
    return done.stdout.split()


@pytest.fixture
def alone(tmp_path):
    """A copy without the folders of the corpus operators and their pipeline."""
    folder = tmp_path / "copy"
    shutil.copytree(REPO, folder, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    return folder


def test_without_corpus_operators(alone):
    found = names(alone)
    assert len(found) > 50 and not [x for x in found if x.startswith("op") or x == "pipeline"]


def test_with_a_pipeline_alone(alone):
    if (REPO / "corpus_pipeline.py").exists():
        shutil.copy(REPO / "corpus_pipeline.py", alone)
    assert "pipeline" not in names(alone)


def test_with_a_broken_operator(alone):
    (alone / "tamarack" / "llm").mkdir()
    (alone / "tamarack" / "llm" / "__init__.py").write_text("import a_library_that_is_not_there\n")
    assert len(names(alone)) > 50
