"""The engine without its corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n == 'pipeline' or n[:2] == 'op' and n[2].isdigit()])"


def names(at):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-B", "-c", SAY], cwd=at, env=env, capture_output=True, text=True)


@pytest.fixture
def copy(tmp_path):
    at = tmp_path / "repo"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    return at


def drop(at):
    shutil.rmtree(at / "tessera" / "llm", ignore_errors=True)
    shutil.rmtree(at / "tests" / "llm", ignore_errors=True)


def test_without_folders_and_pipeline(copy):
    drop(copy)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    said = names(copy)
    assert said.returncode == 0 and said.stdout.split(maxsplit=1)[1].strip() == "[]", said.stderr


def test_without_folders_only(copy):
    drop(copy)
    said = names(copy)
    assert said.returncode == 0 and said.stdout.split(maxsplit=1)[1].strip() == "[]", said.stderr


def test_a_missing_module_within_an_operator_is_an_error(copy):
    at = copy / "tessera" / "llm" / "queries.py"
    if not at.exists():
        pytest.skip("the corpus operators are not here")
    at.write_text(at.read_text() + "\nimport no_such_module\n")
    assert "no_such_module" in names(copy).stderr
