"""The entry module with, without and with broken optional modules."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def entry_of(folder):
    code = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True)
    return done.returncode, done.stdout.split(), done.stderr


@pytest.fixture
def copied(tmp_path):
    shutil.copytree(f"{REPO}/millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    return tmp_path


def test_without_the_optional_modules(copied):
    code, out, _ = entry_of(copied)
    assert code == 0 and int(out[0]) > 40 and out[1] == "False"


@pytest.mark.parametrize("where", ["millrace/llm/queries.py", "corpus_pipeline.py"])
def test_a_mistake_in_an_optional_module_is_an_error(copied, where):
    (copied / "millrace/llm").mkdir()
    for name in ("millrace/llm/__init__.py", "millrace/llm/queries.py", "corpus_pipeline.py"):
        (copied / name).write_text("from millrace.llm import mispelt\n" if name == where else "")
    code, _, error = entry_of(copied)
    assert code != 0 and "mispelt" in error
