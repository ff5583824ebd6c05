"""The driver entry with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q), len(e.oracle_sql()))"


def loaded(folder):
    """Numbers of queries, corpus queries and oracles that the entry of a copy loads."""
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=folder, capture_output=True, text=True, timeout=120,
                          env={**os.environ, "PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"})
    assert done.returncode == 0, done.stderr
    return [int(n) for n in done.stdout.split()[-3:]]


def copied(to, without=()):
    for name in ("sentryframe", "__spark_entry__.py", "corpus_pipeline.py"):
        if not os.path.exists(f"{ROOT}/{name}"):
            continue
        if os.path.isdir(f"{ROOT}/{name}"):
            shutil.copytree(f"{ROOT}/{name}", to / name, ignore=lambda at, names: {
                n for n in names if n == "__pycache__" or os.path.relpath(f"{at}/{n}", ROOT) in without})
        elif name not in without:
            shutil.copy(f"{ROOT}/{name}", to / name)
    return to


@pytest.mark.parametrize("without", [("sentryframe/llm",), ("sentryframe/llm", "corpus_pipeline.py")])
def test_entry_loads_without_the_corpus_operators(tmp_path, without):
    queries, corpus, oracles = loaded(copied(tmp_path, without))
    assert queries >= 170 and corpus == 0 and oracles >= 160


def test_entry_raises_other_missing_modules(tmp_path):
    folder = copied(tmp_path)
    if not (folder / "sentryframe/llm").exists():
        pytest.skip("the corpus operators are not there")
    with open(folder / "sentryframe/llm/__init__.py", "a") as f:
        f.write("\nimport a_module_that_is_not_there\n")
    with pytest.raises(AssertionError, match="a_module_that_is_not_there"):
        loaded(folder)
